"""Incremental indexing: which documents are new or changed, their chunks, and the tables after it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import IndexConfig
from tessera.operators import store
from tessera.operators.chunk import Complete, complete, context_prompt, model_chunks, number_parts
from tessera.operators.embed import Embed, Weigh, counted_words, dense, dense_text, hashed_embedding, metadata_payload, sparse
from tessera.operators.split import Counter, Splitter, count_tokens, packed, parts, recursive


@dataclass
class Indexer:
    """documents and chunks are the stored tables; models, the token counter and the chain of splitters are injected.

    document_steps see the documents that are new or changed, after that is decided; chunk_steps see the chunks and their documents.
    """

    config: IndexConfig = field(default_factory=IndexConfig)
    embed: Embed = hashed_embedding
    weigh: Weigh = counted_words
    model: Complete | None = None
    count: Counter = count_tokens
    splitters: list[Splitter] | None = None
    document_steps: list = field(default_factory=list)
    chunk_steps: list = field(default_factory=list)

    def chunk(self, docs: DataFrame) -> DataFrame:
        """Chunks with their dense vector `full`, sparse vector `keywords` and payload."""
        have = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
        about = metadata_payload(have("creator", "string"), have("created_at", "timestamp")) if {"creator", "created_at"} & set(docs.columns) else F.lit("{}")
        told = docs.withColumn("__about", about)
        limit, count, splitters = self.config.safe_limit, self.count, self.splitters
        model = self.model

        def cut(text: str) -> list[str]:
            return ["\n\n".join(p) for p in packed(recursive(text, limit, count, splitters=splitters), limit, count)]

        texts: Column = parts(cut, F.coalesce("text", F.lit("")))
        if self.config.chunker == "llm" and model:
            asked = docs.withColumn("__b", texts).select("*", F.posexplode("__b").alias("__n", "__t")).drop("__b")
            answered = asked.select("id", "__n", model_chunks(F.col("__t"), model).alias("__c"))
            own = answered.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__c"))), lambda x: x["__c"])).alias("__t"))
            rows = number_parts(told.join(own, "id").withColumnRenamed("id", "doc_id"), F.col("__t"), "__about")
        else:
            rows = number_parts(told.withColumnRenamed("id", "doc_id"), texts, "__about")
        if self.config.context == "llm" and model:
            whole = docs.select(F.col("id").alias("doc_id"), F.col("text").alias("__doc"))
            rows = rows.join(whole, "doc_id").withColumn("context", complete(context_prompt(F.col("__doc"), F.col("text")), model, "")).drop("__doc")
        rows = rows.withColumnRenamed("__about", "payload").withColumn("full", dense(dense_text(), self.embed)).withColumn("keywords", sparse(F.col("text"), self.weigh))
        for step in self.chunk_steps:
            rows = step(rows, docs)
        return rows

    def run(self, source: DataFrame, documents: DataFrame, chunks: DataFrame, prune: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """actions, documents and chunks after indexing. Of several rows with one id the latest counts."""
        source = store.latest(source, "id", [F.col("updated_at"), F.col("size")])
        todo = store.actions(source, documents, chunks)
        changed = source.join(todo.filter("action <> 'skip'").select("id"), "id", "left_semi")
        ids = changed.select("id")
        for step in self.document_steps:
            changed = step(changed)
        docs = store.upsert(documents, changed.withColumn("indexed_at", F.current_timestamp()))
        kept = store.delete(chunks, ids.select(F.col("id").alias("doc_id")), "doc_id")
        if prune:
            docs = store.lookup(docs, source)
            kept = kept.join(source.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        return todo, docs, kept.unionByName(self.chunk(changed), allowMissingColumns=True)
