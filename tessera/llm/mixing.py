"""Temperature mixing of sources to target weights.

A source's weight is its share of all tokens to the power of an exponent between 0 (equal weights) and 1
(shares as they are), normalised. The exponent is bisected: the least one under which no source
is repeated more than `max_repeats` times as often as the least repeated one, or the one whose weights
have a given share of the largest entropy. Weights become a budget of tokens per source; each source
is read in block permutations: every block is a new pseudo-random order of the whole source, and the
last block ends where the budget does. The default budget is the least that reads every source once,
so no document is lost.

Only a source's totals reach the driver, for MOST_SOURCES sources at most (more raise an error). A block's end is found by counting
tokens in hash buckets, so only the bucket in which the budget ends is ever ordered.

Defined results: a null source is a source of its own; a null or empty text counts one token; repeated rows
are read each; equal hashes are ordered by doc_id; an empty table gives an empty table; the
added columns are named by parameters and replace columns of the same names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, text_col

MOST_SOURCES, MAX_REPEATS, BUCKET = 200_000, 2.0, 2000


def token_estimate(text: str = "text") -> Column:
    """A token for every four bytes of text, one at least."""
    return F.greatest(F.ceil(F.octet_length(text_col(text)) / 4.0), F.lit(1)).cast("long")


def normalised(shares: list[float], exponent: float) -> list[float]:
    powers = [p**exponent for p in shares]
    return [x / math.fsum(powers) for x in powers]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def bisect(ok, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The least exponent for which `ok` holds, if it holds from some exponent on up to `high`."""
    if ok(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return high


def exponent_for(shares: list[float], max_repeats: float | None = MAX_REPEATS, entropy_share: float | None = None) -> float:
    """The exponent that meets the repetition limit and, if given, has at most that share of the largest entropy."""

    def ok(a: float) -> bool:
        w = normalised(shares, a)
        repeats = [x / p for x, p in zip(w, shares, strict=True)]
        fine = max_repeats is None or max(repeats) <= max_repeats * min(repeats) * (1 + 1e-12)
        return fine and (entropy_share is None or len(shares) < 2 or entropy(w) <= entropy_share * math.log(len(shares)) + 1e-12)

    return bisect(ok)


def epochs(totals: dict, max_repeats: float | None = MAX_REPEATS, entropy_share: float | None = None, budget: float | None = None) -> dict:
    """How often each source is read, as a fraction; totals: tokens of each source."""
    names, total = sorted(totals, key=lambda s: (s is None, s)), float(sum(totals.values()))
    if not names:
        return {}
    shares = [totals[s] / total for s in names]
    weights = normalised(shares, exponent_for(shares, max_repeats, entropy_share))
    budget = max(total * p / w for p, w in zip(shares, weights, strict=True)) if budget is None else budget
    out = {s: budget * w / (total * p) for s, w, p in zip(names, weights, shares, strict=True)}
    return {s: float(round(x)) if abs(x - round(x)) < 1e-9 else x for s, x in out.items()}


def mix(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy_share: float | None = None, budget: float | None = None, block: str = "block", position: str = "position") -> DataFrame:
    """Every reading of a document: its columns, the number of the block and the position in (0, 1) in the mixture."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in (block, position)]
    sized = docs.select(*own).withColumn("__tokens", token_estimate())
    totals = sized.groupBy("source").agg(F.sum("__tokens").alias("t"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    reads = epochs({r["source"]: r["t"] for r in totals}, max_repeats, entropy_share, budget)
    plan = spark.createDataFrame([(r["source"], int(reads[r["source"]]), float(reads[r["source"]]), int((reads[r["source"]] % 1) * r["t"] + 0.5), max(1, r["n"] // BUCKET)) for r in totals], "__source string, __full int, __reads double, __rest long, __many int")
    planned = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["__source"])).drop("__source")  # MOST_SOURCES rows at most

    def place(b: Column) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(b.cast("int"), "source", "doc_id", F.octet_length(text_col())), 11).cast("double") + 0.5) / float(1 << 53)

    parts = planned.filter("__rest > 0").select("doc_id", "source", "__tokens", "__rest", "__many", F.octet_length(text_col()).alias("__bytes"), place(F.col("__full")).alias("__u")).withColumn("__bucket", F.floor(F.col("__u") * F.col("__many")))
    sums = parts.groupBy("source", "__rest", "__bucket").agg(F.sum("__tokens").alias("s"))
    before = sums.withColumn("b", F.sum("s").over(Window.partitionBy("source").orderBy("__bucket")) - F.col("s"))
    cut = before.filter("b < __rest and b + s >= __rest").select(F.col("source").alias("cs"), F.col("__bucket").alias("cb"), "b")
    last = parts.join(F.broadcast(cut), parts["source"].eqNullSafe(F.col("cs")) & (F.col("__bucket") == F.col("cb")))
    order = Window.partitionBy("source").orderBy("__u", "doc_id", "__tokens")
    ends = last.withColumn("c", F.sum("__tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__tokens") + F.col("b")).filter("c < __rest").groupBy("source").agg(F.max("__u").alias("__end")).withColumnRenamed("source", "__source")
    both = planned.join(F.broadcast(ends), planned["source"].eqNullSafe(ends["__source"]), "left")  # a row per source
    more = F.when((F.col("__rest") > 0) & (place(F.col("__full")) <= F.col("__end")), 1).otherwise(0)
    read = both.withColumn("__n", F.col("__full") + more).filter("__n > 0").withColumn(block, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return read.withColumn(position, F.least((F.col(block) + place(F.col(block))) / F.col("__reads"), F.lit(1.0))).select(*own, block, position)


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "position")
