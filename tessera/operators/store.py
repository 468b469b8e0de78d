"""The two tables behind the index, and what is done to them."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import without_keys

DOCUMENTS = "id string, path string, text string, updated_at timestamp, source_type string, size bigint, indexed_at timestamp, creator string, created_at timestamp, payload string"
CHUNKS = "id string, doc_id string, path string, `order` int, total int, text string, context string, updated_at timestamp, payload string, full array<float>, keywords struct<indices:array<bigint>,values:array<float>>"


def ensure_table(spark: SparkSession, name: str, schema: str, key: str, buckets: int = 64) -> None:
    """Creates a table bucketed by its key unless it exists; an existing table's columns stay as they are."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS")


def latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the last by `order`."""
    w = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def lookup(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_semi")


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The table after writing rows: the new row replaces the old."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The table without the given ids; ids it lacks change nothing."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def replace_path(df: DataFrame, base: str) -> str:
    """Writes a new version of a table below `base` and returns its path; older versions stay readable while a plan uses them."""
    path = f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def index_status(chunks: DataFrame) -> DataFrame:
    """doc_id, n, total: how many chunks are stored and how many there should be."""
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total")).filter("total IS NOT NULL")


def actions(source: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, action for each source document: skip, reindex or new.

    A document is skipped if time and size are as stored and all its chunks are there.
    """
    stored = documents.select("id", F.col("updated_at").alias("__u"), F.col("size").alias("__s"), F.lit(True).alias("__k"))
    status = index_status(chunks).select(F.col("doc_id").alias("id"), "n", "total")
    same = (F.col("updated_at") == F.col("__u")) & (F.col("size") == F.col("__s")) & (F.col("n") == F.col("total"))
    return source.join(stored, "id", "left").join(status, "id", "left").select("id", F.when(F.col("__k").isNull(), "new").when(F.coalesce(same, F.lit(False)), "skip").otherwise("reindex").alias("action"))


#: The fields of a document that aren't extra payload.
CORE = ("id", "path", "text", "updated_at", "source_type", "size", "indexed_at", "creator", "created_at")


def as_documents(points: DataFrame, payload: str = "payload") -> DataFrame:
    """Documents from stored payloads, maps of strings: the core fields as columns, with their types, and the rest as `payload`.

    A missing size is 0, missing times and author are null.
    """
    p = F.col(payload)
    time = lambda k: F.try_to_timestamp(p[k]).alias(k)
    return points.select(p["id"].alias("id"), p["path"].alias("path"), p["text"].alias("text"), time("updated_at"), p["source_type"].alias("source_type"), F.coalesce(F.try_to_number(p["size"], F.lit("999999999999999999")).cast("bigint"), F.lit(0).cast("bigint")).alias("size"), time("indexed_at"), p["creator"].alias("creator"), time("created_at"), without_keys(p, list(CORE)).alias("payload"))


PARTS = 64


def dealt(df: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """Adds the part of the table to which a row belongs, by a hash of its key."""
    return df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


@dataclass
class Current:
    """The versions of both tables that count now, and the last batch of each stream in them. documents is kept by id, chunks by doc_id.

    A table is a folder of versions, each dealt into parts by its key. The newest pointer below `base` names the parts of both tables, so
    they switch together, by one file, and older versions stay readable while a plan uses them.
    """

    spark: SparkSession
    base: str
    documents: DataFrame
    chunks: DataFrame
    batches: dict
    number: int

    @classmethod
    def read(cls, spark: SparkSession, base: str) -> Current:
        try:
            last = spark.read.text(f"{base}/pointers").orderBy(F.desc("value")).first()["value"]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = '0 {"batches": {}, "documents": {}, "chunks": {}}'
        number, found = int(last.split(" ", 1)[0]), json.loads(last.split(" ", 1)[1])
        frames = []
        for name, schema in (("documents", DOCUMENTS), ("chunks", CHUNKS)):
            own = list(found[name].values())
            frames.append(spark.read.schema(schema).parquet(*own) if own else spark.createDataFrame([], schema))
        return cls(spark, base, *frames, found["batches"], number)

    def replace(self, documents: DataFrame, chunks: DataFrame, **batches: int) -> Current:
        """Writes the parts of both tables, then the pointer that makes them count; two writers that began at one version can't both succeed."""
        paths = {}
        for name, df, key, schema in (("documents", documents, "id", DOCUMENTS), ("chunks", chunks, "doc_id", CHUNKS)):
            have = set(df.columns)
            columns = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], schema).schema]
            path = f"{self.base.rstrip('/')}/{name}/v-{uuid.uuid4().hex}"
            dealt(df.select(*columns), key).repartition("part").write.partitionBy("part").parquet(path)
            paths[name] = {str(r["part"]): f"{path}/part={r['part']}" for r in self.spark.read.parquet(path).select("part").distinct().collect()}  # PARTS rows at most
        line = f"{self.number + 1:012d} " + json.dumps({"batches": self.batches | batches, **paths})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("error").text(f"{self.base.rstrip('/')}/pointers/n={self.number + 1:012d}")
        return Current.read(self.spark, self.base)
