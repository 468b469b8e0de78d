"""Approximate nearest neighbours with a permutation index.

Each vector is represented by the REACH pivots nearest to it, in order. It is posted in the inverted files of the first few of
them, with that order alone; a query reads the files of its own first pivots, ranks what it finds there by the footrule distance of the two
orders (pivots that one of them lacks count as REACH), and the best 20 * n ** 0.4 are reranked by exact cosine in double precision.
Pivots are 12 * sqrt(n), up to PIVOTS; a vector is posted in POST files and a query reads 0.48 * pivots / POST of them, so it meets about a
third of all rows, and reranks a share that falls with their number. Up to SMALL rows all files are read.

Pivots are vectors apart from each other among the first by a hash of vec_id, a bounded sample; SAMPLE further rows of that order tell each query how
small a footrule distance has to be to be among the best, so that files pass on few rows; the exact number is cut afterwards. Every row is indexed. Of
rows with one and the same vector only the k + 1 with the smallest ids can be an answer, so no more of them are posted. Queries go through the
files in blocks of BLOCK, of which the orders and vectors are broadcast.

Defined results: vectors that are null, of zero length, or hold null or non-finite components take no part, and neither do null ids and those of
another size than most vectors have, as no cosine is defined between two sizes; equal scores rank by vec_id; repeated rows of one id
count once; queries whose files hold fewer than k rows read all files; with fewer candidates than asked for all are returned; an empty table gives an
empty table; only vec_id and embedding are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stage, unstage

PIVOTS, REACH, POST, SAMPLE, BLOCK, SMALL = 1024, 192, 6, 4096, 8192, 256
RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(fine)
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vec") == (size["d"] if size else 0))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def nearest(units: np.ndarray, pivots: np.ndarray, reach: int) -> np.ndarray:
    """Of every vector its `reach` nearest pivots, nearest first."""
    far = -(units @ pivots.T)
    if reach < far.shape[1]:
        near = np.argpartition(far, reach - 1, axis=1)[:, :reach]
        order = np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable")
        return np.take_along_axis(near, order, 1).astype(np.int16)
    return np.argsort(far, axis=1, kind="stable").astype(np.int16)


def places(orders: np.ndarray, pivots: int) -> np.ndarray:
    """Every pivot's place in each order, the orders' length if it isn't there."""
    out = np.full((len(orders), pivots), orders.shape[1], np.int16)
    np.put_along_axis(out, orders.astype(np.int64), np.arange(orders.shape[1], dtype=np.int16)[None, :], 1)
    return out


def footrule(place: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How far each row's places of the pivots of one order are from theirs in it."""
    return np.abs(place[:, order] - np.arange(len(order), dtype=np.int16)[None, :]).sum(axis=1, dtype=np.int32)


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def postings(rows: DataFrame, pivots: np.ndarray, reach: int, post: int) -> DataFrame:
    """pivot, vec_id, seen: each vector's order, as 16-bit numbers, under each of its `post` nearest pivots."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors at most

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                order = nearest(unit(matrix(part.column(1))), sent.value, reach)
                rows_ = pa.array(np.repeat(np.arange(part.num_rows), post))
                seen = pa.array([x.tobytes() for x in order], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(order[:, :post].ravel().astype(np.int32)), part.column(0).take(rows_), seen.take(rows_)], names=["pivot", "vec_id", "seen"])

    return rows.select("vec_id", "vec").mapInArrow(run, "pivot int, vec_id long, seen binary")


def read_files(files: DataFrame, ids: np.ndarray, orders: np.ndarray, cut: np.ndarray, pivots: int, post: int, read: int, most: int) -> DataFrame:
    """query_id, vec_id, foot: what a block of queries finds in its files, once each, within the queries' cuts."""
    readers: dict[int, list[tuple[int, int]]] = {}
    for q, order in enumerate(orders):
        for j, p in enumerate(order[:read].tolist()):
            readers.setdefault(p, []).append((q, j))
    sent = files.sparkSession.sparkContext.broadcast((ids, orders, cut, readers))  # BLOCK queries at most

    def run(batches):
        ids, orders, cut, readers = sent.value
        for b in batches:
            own = b.column(0).to_numpy()
            for p in np.unique(own).tolist():
                if p not in readers:
                    continue
                at = np.flatnonzero(own == p)
                for s in range(0, len(at), 1024):
                    part = b.take(pa.array(at[s : s + 1024]))
                    vec = part.column(1).to_numpy()
                    place = places(np.frombuffer(b"".join(part.column(2).to_pylist()), np.int16).reshape(len(vec), -1), pivots)
                    got = []
                    for q, j in readers[p]:
                        foot = footrule(place, orders[q])
                        fine = (foot <= cut[q]) & (vec != ids[q])
                        if j:  # those in a file that this query reads before are found there
                            fine &= (place[:, orders[q][:j]] >= post).all(axis=1)
                        near = np.flatnonzero(fine)
                        if len(near) > most:
                            near = near[np.lexsort((vec[near], foot[near]))[:most]]
                        got.append((np.full(len(near), ids[q]), vec[near], foot[near]))
                    cols = [np.concatenate(x) for x in zip(*got, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "foot"])

    return files.mapInArrow(run, "query_id long, vec_id long, foot int")


def rerank(found: DataFrame, rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score of the candidates: rows and candidates meet in buckets of vec_id, the block's query vectors are sent there."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, vectors))  # BLOCK vectors at most
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["query_id", "vec_id", "score"])
        ids, asked = sent.value
        left = left.sort_by("vec_id")
        own = matrix(left["vec"].combine_chunks())
        own = own / np.abs(own).max(axis=1, keepdims=True)
        asked = asked / np.abs(asked).max(axis=1, keepdims=True)
        norm, size = np.sqrt((own * own).sum(axis=1)), np.sqrt((asked * asked).sum(axis=1))
        i, j = np.searchsorted(left["vec_id"].to_numpy(), right["vec_id"].to_numpy()), np.searchsorted(ids, right["query_id"].to_numpy())
        score = np.empty(len(i))
        for s in range(0, len(i), 8192):
            x, y = i[s : s + 8192], j[s : s + 8192]
            score[s : s + 8192] = (own[x] * asked[y]).sum(axis=1) / (norm[x] * size[y])
        order = np.lexsort((right["vec_id"].to_numpy(), -score, j))
        first = np.flatnonzero(np.concatenate([[True], np.diff(j[order]) != 0]))
        keep = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]
        return pa.table([right["query_id"].combine_chunks().take(pa.array(keep)), right["vec_id"].combine_chunks().take(pa.array(keep)), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    return rows.select(dealt.alias("b"), "vec_id", "vec").groupBy("b").cogroup(found.select(dealt.alias("b"), "query_id", "vec_id").groupBy("b")).applyInArrow(compare, RESULT)


def apart(units: np.ndarray, number: int, most: float = 0.8) -> np.ndarray:
    """Up to `number` vectors in their order, none with a cosine over `most` to one before it: pivots side by side would tell nothing of other vectors."""
    kept = np.empty((0, units.shape[1]))
    for s in range(0, len(units), 256):
        part = units[s : s + 256]
        part = part[(part @ kept.T <= most).all(axis=1)] if len(kept) else part
        near = np.triu(part @ part.T > most, 1)
        free = np.ones(len(part), bool)
        for i in range(len(part)):
            if free[i]:
                free[near[i]] = False
        kept = np.concatenate([kept, part[free]])
        if len(kept) >= number:
            break
    return kept[:number]


def shape(n: int) -> tuple[int, int, int, int]:
    """For n rows: how many pivots, files to post to, files to read, and candidates to rerank."""
    if n <= SMALL:
        return max(1, min(16, n)), 1, max(1, min(16, n)), max(1, n)
    pivots = max(16, min(PIVOTS, int(12 * math.sqrt(n)), n // 4))
    return pivots, POST, math.ceil(0.48 * pivots / POST), math.ceil(20 * n**0.4)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every query; queries: rows of the same kind."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors).dropDuplicates(["vec_id"]), "vectors")
    same = Window.partitionBy(F.md5(F.to_binary(F.array_join(F.col("vec").cast("array<string>"), ","), F.lit("utf-8")))).orderBy("vec_id")
    told = stage(rows.withColumn("__n", F.row_number().over(same)).filter(F.col("__n") <= k + 1).drop("__n"), "told")
    n = told.count()
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct().join(rows, "vec_id")
    number, post, read, most = shape(n)
    some = told.orderBy(F.xxhash64("vec_id"), "vec_id").limit(number + SAMPLE).collect()  # at most PIVOTS + SAMPLE vectors
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = unit(np.array([r["vec"] for r in some], np.float64))
    pivots = apart(every, number)
    number = len(pivots)
    reach, post, read = min(REACH, number), min(post, number), number if n <= SMALL else min(read, number)
    files = stage(postings(told, pivots, reach, post).hint("rebalance", "pivot"), "files")
    sample = places(nearest(every, pivots, reach), number)

    def answers(asked: DataFrame, read: int, most: int) -> DataFrame:
        """The k best of every query, staged."""
        best = spark.createDataFrame([], RESULT)
        blocks = max(1, -(-asked.count() // BLOCK))
        for b in range(blocks):
            got = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()  # about BLOCK vectors
            if not got.num_rows:
                continue
            ids, own = got["vec_id"].to_numpy(), matrix(got["vec"].combine_chunks())
            orders = nearest(unit(own), pivots, reach)
            place = min(len(sample) - 1, math.ceil(1.5 * most / n * len(sample)) + 8)
            cut = np.array([np.partition(footrule(sample, o), place)[place] for o in orders]) if most < n else np.full(len(ids), 1 << 30)
            first = F.row_number().over(Window.partitionBy("query_id").orderBy("foot", "vec_id"))
            found = read_files(files, ids, orders, cut, number, post, read, most).withColumn("__r", first).filter(F.col("__r") <= most)
            best = best.unionByName(rerank(found, told, ids, own, k))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return stage(best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")

    out = answers(asked, read, most)
    full = out.groupBy("query_id").count().filter(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = asked.join(full, "vec_id", "left_anti")
    if read < number and short.take(1):
        out = out.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(answers(short, number, n))
    for x in (files, told):
        unstage(x)
    return out


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.pmod("vec_id", F.lit(50)) == 0))
