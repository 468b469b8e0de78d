"""From blocks to numbered chunks, and the model answers that cut or describe them."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import pack, point_id, strip

Complete = Callable[[str], str]

CHUNK_PROMPT = 'Divide the text into parts that each make sense alone. Answer with JSON: {"chunks": ["...", "..."]}.'


def echo(prompt: str) -> str:
    """Stand-in for a language model."""
    return prompt


def complete(c: Column, model: Complete = echo, otherwise: str | None = None) -> Column:
    """A model's answers; with `otherwise`, any failure gives that text instead of an error."""

    @F.arrow_udf("string")
    def run(prompts: pa.Array) -> pa.Array:
        out = []
        for p in prompts.to_pylist():
            try:
                out.append(model(p))
            except Exception:
                if otherwise is None:
                    raise
                out.append(otherwise)
        return pa.array(out, pa.string())

    return run(c)


def valid_chunks(answer: Column) -> Column:
    """The non-blank strings under `chunks` of a JSON answer, or null if there are none."""
    found = F.try_variant_get(F.try_parse_json(answer), "$.chunks", "array<variant>")
    texts = F.transform(F.filter(found, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    kept = F.filter(texts, lambda x: strip(x) != "")
    return F.when(F.size(kept) > 0, kept)


def chunks_or_block(answers: list[Column], block: Column) -> Column:
    """The first valid of several answers, else the block itself."""
    return F.coalesce(*[valid_chunks(a) for a in answers], F.array(block))


def cutter(model: Complete, tries: int = 3) -> Callable[[str], list[str]]:
    """Asks a model to cut a block, up to `tries` times; without a valid answer the block stays whole. Errors of the connection are not hidden."""

    def cut(text: str) -> list[str]:
        for _ in range(tries):
            try:
                found = json.loads(model(f"{CHUNK_PROMPT}\n\n{text}"))["chunks"]
            except (ValueError, KeyError, TypeError):  # no JSON, no such key, or no answer at all
                continue
            kept = [x for x in found if isinstance(x, str) and x.strip()] if isinstance(found, list) else []
            if kept:
                return kept
        return [text]

    return cut


def model_chunks(block: Column, model: Complete, tries: int = 3) -> Column:
    """The parts into which a model cuts each block."""
    cut = cutter(model, tries)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(block)


def context_prompt(document: Column, chunk: Column) -> Column:
    return F.concat(F.lit("Document:\n"), document, F.lit("\n\nPart:\n"), chunk, F.lit("\n\nSay in one sentence what the part is about."))


def number_parts(docs: DataFrame, texts: Column, *more: str) -> DataFrame:
    """One row per text of each document: id, doc_id, path, order, total, text, context, updated_at, and `more` columns of the document.

    The count and the numbers come from the document's own array, so no shuffle is needed.
    """
    rows = docs.withColumn("__p", texts).select("doc_id", "path", "updated_at", *more, F.size("__p").alias("total"), F.posexplode("__p").alias("order", "text"))
    return rows.select(point_id(F.concat_ws("#", "doc_id", "order")).alias("id"), "doc_id", "path", "order", "total", "text", F.lit("").alias("context"), "updated_at", *more)


def number_chunks(docs: DataFrame, blocks: Column, limit: int, cut: Callable[[Column], Column] | None = None) -> DataFrame:
    """The same, of blocks packed up to `limit` tokens; `cut` divides each pack further."""
    texts = F.transform(pack(blocks, limit), lambda p: F.array_join(p, "\n\n"))
    return number_parts(docs, texts if cut is None else F.flatten(F.transform(texts, cut)))
