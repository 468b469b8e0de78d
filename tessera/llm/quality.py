"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (words, word shapes and punctuation, and the shares of shapes in steps)
are scaled by the log ratio of the two classes' smoothed counts; a linear hinge-loss model over
them is fitted by dual coordinate descent and blended with its mean weight; its margin becomes
a score by a logistic curve fitted on margins of folds that the model has not seen.

The fit uses at most `max_train` labelled rows, the lowest by a hash of doc_id; scoring covers
every row. Defined results: a null text is an empty text; null labels are not used; with several
labels for a doc_id the highest counts; without labels of both classes every score is 0.5; a null
doc_id is not held out; repeated rows get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import read_table, text_col
from .kernels import IS_WORD, begin, flat, mix, salt, span_hashes, spans, text_slices, tidy

BITS, MAX_TRAIN, THRESHOLD, SLICE = 18, 3000, 0.3, 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1
DIGIT = np.zeros(256, np.int64)
DIGIT[48:58] = 1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of all texts, (text's number, feature) in order.

    Tokens are runs of word bytes and runs of other visible bytes. Features are token uni- and
    bigrams, uni- to trigrams of shapes (letter case, digits, repeat of the token before; punctuation
    as it stands), the share of each shape among the text's tokens in powers of two, and the
    number of tokens in powers of two.
    """
    body, offs = flat(texts)
    word = IS_WORD[body]
    a1, e1 = spans(body, offs, word)
    a2, e2 = spans(body, offs, ~word & ~SPACE[body])
    starts, ends = np.concatenate([a1, a2]), np.concatenate([e1, e2])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    first = np.searchsorted(starts, offs)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(of: np.ndarray, h: np.ndarray, kind: int) -> None:
        parts.append((of, (mix(h + salt(kind)) >> np.uint64(64 - BITS)).astype(np.int64)))

    if len(starts):
        h = span_hashes(LOWER[body], starts, ends)
        ups = np.concatenate([[0], np.cumsum(UPPER[body])])
        nums = np.concatenate([[0], np.cumsum(DIGIT[body])])
        up, num, size = ups[ends] - ups[starts], nums[ends] - nums[starts], ends - starts
        is_word = word[starts]
        case = np.where(up == 0, 0, np.where(up == size, 2, np.where(UPPER[body[starts]] == 1, 1, 3)))
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
        shape = np.where(is_word, mix((case * 4 + np.minimum(num, 1) * 2 + same).astype(np.uint64)), h)
        inner = doc[1:] == doc[:-1]
        two = inner[1:] & inner[:-1]
        add(doc, h, 1)
        add(doc[1:][inner], (h[:-1] * np.uint64(3) + h[1:])[inner], 2)
        add(doc, shape, 3)
        add(doc[1:][inner], (shape[:-1] * np.uint64(3) + shape[1:])[inner], 4)
        add(doc[2:][two], (shape[:-2] * np.uint64(9) + shape[1:-1] * np.uint64(3) + shape[2:])[two], 5)
        by_shape = (doc.astype(np.uint64) << np.uint64(48)) | (shape >> np.uint64(16))
        kinds, times = np.unique(by_shape, return_counts=True)
        of = (kinds >> np.uint64(48)).astype(np.int64)
        step = np.floor(-np.log2(times / n[of])).astype(np.uint64)
        add(of, kinds & np.uint64((1 << 48) - 1) | (step << np.uint64(48)), 6)
    add(np.arange(len(n)), np.floor(np.log2(n + 1)).astype(np.uint64), 7)
    keys = np.unique(np.concatenate([(of << BITS) | f for of, f in parts]))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log ratio of the classes' smoothed and normalised feature counts."""
    sums = []
    for c in (1, -1):
        own = [r for r, k in zip(rows, y, strict=True) if k == c]
        counts = alpha + np.bincount(np.concatenate(own), minlength=1 << BITS)
        sums.append(counts / counts.sum())
    return np.log(sums[0] / sums[1])


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = 0.1, passes: int = 12, blend: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights over indicators and the bias, by dual coordinate descent on the hinge loss.

    Each class has the same total cost. Features are r at the indicators, scaled to length 1.
    """
    w, bias = np.zeros(len(r)), 0.0
    alpha = np.zeros(len(rows))
    values = [r[x] / max(1e-9, math.sqrt(float(r[x] @ r[x]))) for x in rows]
    share = {c: len(y) / (2 * max(1, int((y == c).sum()))) for c in (1, -1)}
    pick = np.random.default_rng(7)
    for _ in range(passes):
        for i in pick.permutation(len(rows)):
            x, v, c = rows[i], values[i], y[i]
            grad = c * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - grad / 2, 0.0), cost * 100 * share[c])
            if new != alpha[i]:
                w[x] += (new - alpha[i]) * c * v
                bias += (new - alpha[i]) * c
                alpha[i] = new
    return (1 - blend) * np.abs(w).mean() * np.sign(w) + blend * w, bias * blend


def margin(rows: list[np.ndarray], w: np.ndarray, bias: float, r: np.ndarray) -> np.ndarray:
    return np.array([float(w[x] @ r[x]) / max(1e-9, math.sqrt(float(r[x] @ r[x]))) + bias for x in rows])


def logistic(m: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of P(label 1 | margin), by Newton steps on smoothed targets."""
    n1, n0 = int((y == 1).sum()), int((y != 1).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([m, np.ones(len(m))], axis=1)
    c = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - t))
        c -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0]), float(c[1])


def train(rows: list[np.ndarray], labels: np.ndarray, folds: int = 4) -> tuple[np.ndarray, float]:
    """One weight per feature (ratio and length scaling apart), packed as (w, r, bias, slope, offset)."""
    y = np.where(labels == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        return (np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 0.0)
    fold = np.arange(len(y)) % folds
    seen, own = [], []
    for k in range(folds):
        t, v = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[t].tolist())) < 2 or not len(v):
            continue
        tr = [rows[i] for i in t]
        r = ratios(tr, y[t])
        seen.append(margin([rows[i] for i in v], *descend(tr, y[t], r), r))
        own.append(y[v])
    r = ratios(rows, y)
    w, bias = descend(rows, y, r)
    m, t = (np.concatenate(seen), np.concatenate(own)) if seen else (margin(rows, w, bias, r), y)
    return (w, r, bias, *logistic(m, t))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple:
    """Trains on the driver from at most max_train labelled rows that are not held out."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    some = docs.select("doc_id", text_col().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")  # max_train rows at most

    def extract(batches):
        begin("quality")
        for b in batches:
            texts = b.column(2)
            for a, e in text_slices(texts, SLICE):
                of, f = features(texts.slice(a, e - a))
                cuts = np.searchsorted(of, np.arange(e - a + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), b.column(1).slice(a, e - a), pa.array([f[i:j].astype("<i4").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["doc_id", "quality", "f"])

    found = some.withColumn("quality", F.col("quality").cast("int")).mapInArrow(extract, "doc_id long, quality int, f binary").toPandas()
    found = found.drop_duplicates("doc_id").sort_values("doc_id")
    model = train([np.frombuffer(x, "<i4") for x in found["f"]], found["quality"].to_numpy())
    del found
    tidy()
    return model


def score(docs: DataFrame, model: tuple, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Adds the score of every row's whole text, named `name`, to the columns `keep` (default: all); one of them of that name is an error."""
    keep = docs.columns if keep is None else keep
    if name in keep:
        raise ValueError(f"the table has a column {name} already")
    w, r, bias, slope, offset = model
    sent = docs.sparkSession.sparkContext.broadcast(((w * r).astype(np.float64), r * r))  # 2 ** BITS numbers each
    schema = docs.select(*keep, F.lit(0.0).alias(name)).schema
    at = keep.index("text") if "text" in keep and schema["text"].dataType == StringType() else -1  # a kept text isn't sent twice; flat reads null as empty
    rows = docs.select(*keep) if at >= 0 else docs.select(*keep, text_col().alias("__text"))

    def apply(batches):
        begin("quality")
        wr, rr = sent.value
        for b in batches:
            texts = b.column(at)
            out = [np.zeros(0)]
            for a, e in text_slices(texts, SLICE):
                of, f = features(texts.slice(a, e - a))
                m = np.bincount(of, wr[f], e - a) / np.maximum(1e-9, np.sqrt(np.bincount(of, rr[f], e - a))) + bias
                out.append(1 / (1 + np.exp(-np.clip(m * slope + offset, -30, 30))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.concatenate(out))], names=[*keep, name])
        tidy()

    return rows.mapInArrow(apply, schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
