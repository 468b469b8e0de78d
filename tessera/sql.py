"""The engine's functions and tables for SQL text: scalar functions, and splitters as table functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import split
from tessera.sources.html import to_markdown

#: Scalar functions as SQL expressions, so Catalyst inlines them.
SCALARS = {
    "token_count": ("t STRING", "BIGINT", "CAST(ceil(char_length(t) / 4.0) AS BIGINT)"),
    "token_index": ("t STRING", "BIGINT", "(" + " + ".join(f"CAST(conv(substr(md5(t), {k}, 8), 16, 10) AS BIGINT)" for k in (1, 9, 17, 25)) + ") % 4294967295"),
    "cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"),
}


def register(spark: SparkSession) -> None:
    """token_count, token_index, cosine and html_markdown as functions; recursive_split(text, limit) as a table function."""
    for name, (arguments, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")

    @F.arrow_udf("string")
    def html_markdown(pages: pa.Array) -> pa.Array:
        return pa.array([to_markdown(p) for p in pages.to_pylist()], pa.string())

    spark.udf.register("html_markdown", html_markdown)

    @F.udtf(returnType="pos int, part string")
    class RecursiveSplit:
        def eval(self, text: str, limit: int):
            for i, p in enumerate(split.recursive(text or "", limit)):
                yield i, p

    spark.udtf.register("recursive_split", RecursiveSplit)
