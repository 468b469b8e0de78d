"""From dialogs to answers: intent, hybrid search, neighbours, judge, context, answer and events, for many dialogs at once or one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import RetrievalConfig
from tessera.operators import dialog, retrieve
from tessera.operators.chunk import Complete, complete, echo
from tessera.operators.embed import QUERY_PREFIX, Embed, Weigh, counted_words, dense, hashed_embedding, sparse
from tessera.staging import stage

NOTHING = "Nothing relevant was found."


@dataclass
class RagResult:
    """intents: conv_id, intent; chunks: what the judge kept, with comments; answers: conv_id, answer; events: conv_id, n, event, in their order."""

    intents: DataFrame
    chunks: DataFrame
    answers: DataFrame
    events: DataFrame


def keep_all(prompt: str) -> str:
    return "1 | kept"


def search(intents: DataFrame, chunks: DataFrame, postings: DataFrame, config: RetrievalConfig, embed: Embed = hashed_embedding, weigh: Weigh = counted_words) -> DataFrame:
    """query, id, score, rank; chunks: id, full; postings: id, keywords (stored sparse vectors) or id, idx, w."""
    asked = intents.select(F.col("conv_id").alias("query"), sparse(F.col("intent"), weigh).alias("keywords"))
    vectors = intents.select(F.col("conv_id").alias("query"), dense(F.col("intent"), embed, QUERY_PREFIX).alias("qvec"))
    return retrieve.hybrid(postings, chunks.select("id", F.col("full").alias("vec")), asked, vectors, config.top_k, config.prefetch_factor, config.rrf_k, config.rank_base)


def judge_prompt():
    """What a judge is asked about a chunk: question, text, context and path."""
    return F.concat(F.lit("Question: "), "intent", F.lit("\nText: "), "text", F.lit("\nContext: "), F.coalesce("context", F.lit("")), F.lit("\nPath: "), "path", F.lit("\nAnswer 1 | why, or 0."))


def answer(messages: DataFrame, chunks: DataFrame, postings: DataFrame, config: RetrievalConfig | None = None, embed: Embed = hashed_embedding, weigh: Weigh = counted_words, intent_model: Complete = echo, judge: Complete = keep_all, answer_model: Complete = echo) -> RagResult:
    """messages: conv_id, turn, role, text; chunks: id, doc_id, path, order, text, full, and context and updated_at if there; postings: id, keywords, or id, idx, w.

    Intents and hits are staged, as several plans read them. No model is called for a dialog of a single message, for its intent, or for one without a kept chunk, for its answer.
    """
    config = config or RetrievalConfig()
    intents = stage(dialog.intent(messages, lambda d: complete(d, intent_model)), "intents")
    found = stage(search(intents, chunks, postings, config, embed, weigh).join(chunks.select("id", "doc_id", "order"), "id"), "hits")
    near = found.select("query", F.concat_ws("\n", F.col("query").cast("string"), "doc_id").alias("doc_id"), "order", "score", F.col("doc_id").alias("__doc"))
    per = chunks.select(F.col("doc_id").alias("__doc"), "order").join(near.select("query", "doc_id", "__doc").distinct(), "__doc").select("doc_id", "order")
    names = near.select("doc_id", "query", "__doc").distinct()
    wide = retrieve.neighbours(near.select("doc_id", "order", "score"), per, config.window).join(names, "doc_id").select("query", F.col("__doc").alias("doc_id"), "order", "score")
    own = [c for c in ("context", "updated_at") if c in chunks.columns]
    full = wide.join(chunks.select("doc_id", "order", "path", "text", *own), ["doc_id", "order"]).join(intents.select(F.col("conv_id").alias("query"), "intent"), "query")
    full = full if "context" in own else full.withColumn("context", F.lit(""))
    kept = retrieve.judged(full, complete(judge_prompt(), judge))
    context = retrieve.assemble(kept).withColumnRenamed("query", "conv_id")
    asked = intents.join(context, "conv_id", "left").select("conv_id", F.concat("intent", F.lit("\n\n"), "context").alias("prompt"))
    answers = asked.select("conv_id", complete(F.col("prompt"), lambda p: NOTHING if p is None else answer_model(p)).alias("answer"))
    return RagResult(intents, kept, answers, events(intents, wide, kept))


def events(intents: DataFrame, searched: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n, event: what is searched for, how much is judged, what came of it, and a citation for each kept chunk."""
    many = lambda df: df.groupBy(F.col("query").alias("conv_id")).agg(F.count(F.lit(1)).alias("m"))
    count = lambda df: intents.select("conv_id").join(many(df), "conv_id", "left").select("conv_id", F.coalesce("m", F.lit(0)).cast("string").alias("m"))
    say = lambda df, n, text, done: df.select("conv_id", F.lit(n).cast("bigint").alias("n"), dialog.status_event(text, done).alias("event"))
    out = say(intents, 0, F.concat(F.lit("🔎 "), "intent"), F.lit(False))
    out = out.unionByName(say(count(searched), 1, F.concat(F.lit("🔍 judging "), "m", F.lit(" chunks")), F.lit(False)))
    out = out.unionByName(say(count(kept), 2, F.when(F.col("m") == "0", F.lit("❌ no relevant chunks")).otherwise(F.concat(F.lit("✅ "), "m", F.lit(" relevant chunks"))), F.lit(True)))
    place = 2 + F.row_number().over(Window.partitionBy("query").orderBy("doc_id", "order"))
    return out.unionByName(kept.select(F.col("query").alias("conv_id"), place.cast("bigint").alias("n"), dialog.citation_event(F.col("name"), F.col("text"), F.col("path")).alias("event")))


def pipe(messages: DataFrame, conv_id, chunks: DataFrame, postings: DataFrame, stream: Callable[[str], Iterator[str]], **models) -> Iterator[str]:
    """One dialog's events as JSON, the judge's comments between think marks, and then the answer piece by piece, as a chat front end takes them."""
    done = answer(messages.filter(F.col("conv_id") == conv_id), chunks, postings, **models)
    said = [r["event"] for r in done.events.orderBy("n").collect()]  # one dialog's: three and its top_k chunks with their neighbours
    kept = done.chunks.orderBy("doc_id", "order").select("name", "comment").collect()
    yield from said[:2]
    yield "<think>"
    yield from (f"[{r['name']}]: ✔ {r['comment']}\n" for r in kept)
    yield "</think>"
    yield from said[2:]
    if not kept:
        yield NOTHING
        return
    intent = done.intents.first()["intent"]
    yield from stream(f"{intent}\n\n{retrieve.assemble(done.chunks).first()['context']}")
