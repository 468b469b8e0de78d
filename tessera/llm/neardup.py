"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

1. Document frequencies of five-word shingles are counted over all documents in 2**18 hash buckets; what other
   shingles add to a bucket is taken off as the median of all buckets, so that frequencies don't rise with the corpus. A
   shingle's weight is its count in the text times 1 + spread * log((1 + N) / (1 + df)) / log(1 + N): between 1
   and 1 + spread times the count. spread is a parameter; its default of 1 lets an edit that no other text has outweigh words
   which very many copies share by 2 at most. With log(N) for it, near copies of texts with thousands of copies would part.
2. Each text gets BANDS * ROWS weighted samples; texts that agree in all samples of a band meet.
3. In each band's bucket all texts are compared, by exact weighted Jaccard similarity (0.8 or more links them), with
   one of them: that of the least mean weight, which has the fewest shingles of its own and so resembles the most others.
4. Texts in buckets where several classes are left are joined exactly, whatever the bucket's size. Of their shingles only those
   that occur in several classes are posted, the rarest first, and of these only those before which 1 - similarity of the text's
   weight lies at most; what lies before a common shingle on either side bounds the overlap. Again, first one text of the largest
   class under a shingle is compared, then all texts of different classes that the bounds let through. No pair is left out; only
   texts that pass the bounds and still don't match cost the square of their number.
5. Connected components of the links are the classes; a class's id is its smallest doc_id.

Equal texts are one node from the start, whatever their number. Defined results: a null text is
an empty text; texts without a word equal only the same text; a null doc_id takes part and is the
class's id only if no other row has one; a class is told from others by its root, as classes with null
or reused doc_ids may have the same id; repeated rows share a class; an empty table gives an
empty table; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stage, text_col, unstage
from .graph import components
from .kernels import begin, mix, salt, shingles, text_slices, tidy

WIDTH, SIMILARITY, BANDS, ROWS, BUCKETS, SPREAD = 5, 0.8, 12, 3, 18, 1.0


def bucket(h: np.ndarray) -> np.ndarray:
    """The frequency bucket of 48-bit shingle hashes."""
    return (h & np.uint64((1 << BUCKETS) - 1)).astype(np.int64)


def weights(docs: DataFrame, spread: float = SPREAD) -> np.ndarray:
    """The weight of every bucket's shingles by their document frequency, over all documents."""

    def count(batches):
        begin("neardup")
        seen, n = np.zeros(1 << BUCKETS, np.int64), 0
        for b in batches:
            for a, e in text_slices(b.column(0)):
                h, _, of = shingles(b.column(0).slice(a, e - a), WIDTH)
                keys = np.unique((of << BUCKETS) | bucket(h))
                seen += np.bincount(keys & ((1 << BUCKETS) - 1), minlength=1 << BUCKETS)
                n += e - a
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], names=["k", "n"])
        tidy()

    found = docs.select(text_col().alias("text")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # 2 ** BUCKETS + 1 rows at most
    k, n = found["k"].to_numpy(), found["n"].to_numpy()
    df = np.zeros(1 << BUCKETS)
    df[k[k >= 0]] = n[k >= 0]
    total = float(n[k < 0].sum())
    del found
    tidy()
    df = np.clip(df - np.median(df), 1, max(1, total))
    return (1 + spread * np.log((1 + total) / (1 + df)) / max(np.log(1 + total), 1e-9)).astype(np.float32) if total else np.ones(1 << BUCKETS, np.float32)


def samples(h: np.ndarray, w: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Improved consistent weighted samples: row j has sample j of every run that begins at `starts`.

    For each element, r and c are drawn from Gamma(2, 1) and beta from (0, 1) by hashing the element
    with j; t = floor(ln w / r + beta), y = exp(r (t - beta)), a = c / (y e^r), and the element with
    the least a is sampled together with t.
    """
    sizes = np.diff(np.append(starts, len(h)))
    log_w = np.log(w.astype(np.float32))
    out = np.empty((count, len(starts)), np.uint64)
    unit, half = np.float32(2.0**-32), np.float32(2.0**-33)
    for j in range(count):
        x = mix(h + salt(2 * j + 1)).view(np.uint32)
        y = mix(h + salt(2 * j + 2)).view(np.uint32)
        u1, u2 = x[0::2].astype(np.float32) * unit + half, x[1::2].astype(np.float32) * unit + half
        u3, u4 = y[0::2].astype(np.float32) * unit + half, (y[1::2] & np.uint32(0xFFFF)).astype(np.float32) * np.float32(2.0**-16) + np.float32(2.0**-17)
        beta = (y[1::2] >> np.uint32(16)).astype(np.float32) * np.float32(2.0**-16)
        r = np.maximum(-np.log(u1 * u2), np.float32(1e-6))
        t = np.floor(log_w / r + beta)
        a = np.log(np.maximum(-np.log(u3 * u4), np.float32(1e-30))) - r * (t - beta) - r
        low = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == np.repeat(low, sizes))
        run = np.searchsorted(starts, hit, side="right") - 1
        hit = hit[np.concatenate([[True], run[1:] != run[:-1]])]
        out[j] = mix(h[hit] ^ mix(t[hit].astype(np.int64).view(np.uint64)))
    return out


def signatures(docs: DataFrame, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (the text's MD5), mean weight and band hashes of every document; texts without words have none."""
    sent = docs.sparkSession.sparkContext.broadcast(idf)  # 2 ** BUCKETS numbers

    def sign(batches):
        begin("neardup")
        w = sent.value
        for b in batches:
            for a, e in text_slices(b.column(1)):
                texts = b.column(1).slice(a, e - a)
                h, times, of = shingles(texts, WIDTH)
                out: list = [[] for _ in range(e - a)]
                mean = np.zeros(e - a)
                if len(h):
                    mean = np.bincount(of, times * w[bucket(h)], e - a) / np.maximum(np.bincount(of, times, e - a), 1)
                    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                    s = samples(h, times * w[bucket(h)], starts, bands * rows)
                    keys = np.empty((len(starts), bands), np.uint64)
                    for k in range(bands):
                        acc = np.full(len(starts), salt(k + 1))
                        for row in s[k * rows : (k + 1) * rows]:
                            acc = mix(acc * np.uint64(3) + row)
                        keys[:, k] = acc
                    for i, row in zip(of[starts].tolist(), keys.view(np.int64), strict=True):
                        out[i] = row
                nodes = [hashlib.md5(x.as_py().encode()).digest() for x in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array(nodes, pa.binary()), pa.array(mean), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "node", "mean", "bands"])
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).mapInArrow(sign, "doc_id long, node binary, mean double, bands array<long>")


def similarity(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of texts side by side."""
    n = len(left)
    h1, t1, o1 = shingles(left, WIDTH)
    h2, t2, o2 = shingles(right, WIDTH)
    k1, k2 = (o1.astype(np.uint64) << np.uint64(48)) | h1, (o2.astype(np.uint64) << np.uint64(48)) | h2
    at = np.minimum(np.searchsorted(k1, k2), max(0, len(k1) - 1))
    same = k1[at] == k2 if len(k1) else np.zeros(len(k2), bool)
    both = np.bincount(o2[same], np.minimum(t1[at[same]], t2[same]) * idf[bucket(h2[same])].astype(np.float64), n)
    total = np.bincount(o1, t1 * idf[bucket(h1)].astype(np.float64), n) + np.bincount(o2, t2 * idf[bucket(h2)].astype(np.float64), n)
    return both / np.maximum(total - both, 1e-12)


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """a, b, score of each pair of nodes; texts: node, text, one row per node."""
    sent = pairs.sparkSession.sparkContext.broadcast(idf)
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")

    def compare(batches):
        begin("neardup")
        for b in batches:
            sizes = pc.add(pc.binary_length(b.column(2)), pc.binary_length(b.column(3))).to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            a = 0
            while a < b.num_rows:
                e = min(max(a + 1, int(np.searchsorted(ends, ends[a] + (4 << 20)))), a + (1 << 14), b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), b.column(1).slice(a, e - a), pa.array(similarity(b.column(2).slice(a, e - a), b.column(3).slice(a, e - a), sent.value))], names=["a", "b", "score"])
                a = e
        tidy()

    return two.mapInArrow(compare, "a binary, b binary, score double")


def prefixes(texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """node, key, size, before: postings of which two texts of different classes share one if their similarity reaches the threshold; staged.

    texts: node, root, text. Shingles in one class only take no part. The others are ordered by how many of these texts have them, the
    rarest first, and by hash; `before` is the weight of those ahead and of all that take no part, `size` that of all. The
    first common one has the whole overlap behind it, which is threshold * size at least.
    """
    sent = texts.sparkSession.sparkContext.broadcast(idf)

    def post(batches):
        begin("neardup")
        w_all = sent.value
        for b in batches:
            for a, e in text_slices(b.column(2)):
                h, times, of = shingles(b.column(2).slice(a, e - a), WIDTH)
                w = times * w_all[bucket(h)].astype(np.float64)
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a).take(rows), b.column(1).slice(a, e - a).take(rows), pa.array(h.view(np.int64)), pa.array(w), pa.array(np.bincount(of, w, e - a)[of])], names=["node", "class", "key", "w", "size"])

    every = stage(texts.select("node", F.xxhash64("root").alias("class"), "text").mapInArrow(post, "node binary, class long, key long, w double, size double"), "shingles")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("key", "n")
    own = Window.partitionBy("node")
    ahead = F.col("size") - F.sum("w").over(own) + F.coalesce(F.sum("w").over(own.orderBy("n", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = stage(every.join(shared, "key").select("node", "key", "size", ahead.alias("before")).filter(F.col("before") <= (1 - threshold + 1e-6) * F.col("size")), "posts")
    unstage(every)
    return out


def buckets(posts: DataFrame) -> DataFrame:
    """The keys where classes meet, and the largest class there."""
    by = posts.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("t")).filter("n > t.n").select("key", F.col("t.root").alias("top"))


def meet(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of different classes under one key whose weights allow the threshold."""
    x, y = left.alias("x"), right.alias("y")
    behind = F.least(F.col("x.size") - F.col("x.before"), F.col("y.size") - F.col("y.before"))
    able = behind >= (threshold / (1 + threshold) - 1e-6) * (F.col("x.size") + F.col("y.size"))
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & able).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def classes(docs: DataFrame, threshold: float = SIMILARITY, spread: float = SPREAD) -> DataFrame:
    """One row per document: doc_id, node, root (the class), class_id, class_size."""
    idf = weights(docs, spread)
    signed = stage(signatures(docs, idf), "signatures")
    met = signed.dropDuplicates(["node"]).select("node", "mean", F.explode("bands").alias("key"))
    tops = met.groupBy("key").agg(F.min(F.struct("mean", "node")).alias("t"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.col("t.node").alias("top"))
    met = stage(met.join(tops, "key").select("key", "node", "top"), "met")
    every = docs.select(text_col().alias("text")).withColumn("node", F.unhex(F.md5("text")))
    texts = stage(every.join(met.select("node").distinct(), "node").dropDuplicates(["node"]), "texts")

    def joined(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
        """The classes after these pairs' comparison."""
        found = verified(pairs.distinct(), texts, idf).filter(F.col("score") >= threshold).select("a", "b")
        out = components(found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if roots is not None:
            unstage(roots)
        return out

    def rooted(table: DataFrame, roots: DataFrame) -> DataFrame:
        return table.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    roots = joined(met.filter("node <> top").select(F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b")), None)
    left = rooted(met.select("key", "node"), roots)
    left = stage(left.join(buckets(left).select("key"), "key").select("node", "root").distinct(), "left")
    unstage(met)
    if left.take(1):
        posts = prefixes(texts.join(left, "node"), idf, threshold)
        for first in (True, False):
            live = rooted(posts, roots)
            live = stage(live.join(buckets(live), "key"), "live")
            others = live.filter("root <> top")
            if first:
                lead = live.filter("root = top").groupBy("key").agg(F.min(F.struct(F.expr("before / size").alias("o"), "node", "root", "size", "before")).alias("l"))
                pairs = meet(lead.select("key", "l.node", "l.root", "l.size", "l.before"), others, threshold)
            else:
                pairs = meet(others, live, threshold)
            roots = joined(pairs, roots)
            unstage(live)
        unstage(posts)
    unstage(left)
    unstage(texts)
    member = signed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    ids = member.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return member.join(ids, "root").select("doc_id", "node", "root", "class_id", "class_size")


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents with one of each class left: the one with the smallest doc_id, null if there is no other."""
    found = classes(docs, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("f")
    chosen = found.groupBy("root").agg(first).select(F.col("f.doc_id").alias("__doc"), F.col("f.node").alias("__node"))
    marked = docs.withColumn("__node", F.unhex(F.md5(text_col())))
    kept = marked.join(chosen, (marked["doc_id"].eqNullSafe(chosen["__doc"])) & (marked["__node"] == chosen["__node"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__node"]).select(*docs.columns)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", F.lower(F.hex("root")).alias("class_root"))
