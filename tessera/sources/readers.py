"""Sources: folders of Markdown files and pages of a wiki, as documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import WikiFilter
from tessera.functions import iso_time

from .html import Describe, markdown

PAGE_SIZE = 200

#: A stored wiki page: fields below `content` or at the top.
PAGE = "id string, title string, space struct<key:string>, body struct<view:struct<value:string>>, history struct<lastUpdated:struct<when:string>,createdBy:struct<displayName:string>,createdDate:string,createdAt:string>"


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """One document per *.md file below root; id and path are relative to it. Files that vanish are left out; text that isn't UTF-8 is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreMissingFiles", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    name = F.url_decode(F.replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), F.lit("+"), F.lit("%2B")))
    rel = F.substring(name, len(base) + 2, 1 << 20)
    text = F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n"))
    return files.select(rel.alias("id"), rel.alias("path"), text.alias("text"), F.col("modificationTime").alias("updated_at"), F.lit("markdown").alias("source_type"), F.col("length").alias("size"))


def wiki_predicate(f: WikiFilter, id_: Column, space: Column, ancestors: Column) -> Column:
    """Pages below (or equal to) the wanted ancestors, or else in the wanted spaces, but not below the unwanted ones."""
    keep: Column = F.lit(True)
    if f.ancestor_ids:
        keep = F.arrays_overlap(ancestors, F.array(*map(F.lit, f.ancestor_ids))) | id_.isin(*f.ancestor_ids)
    elif f.spaces:
        keep = space.isin(*f.spaces)
    if f.skip_ancestor_ids:
        keep = keep & ~F.arrays_overlap(ancestors, F.array(*map(F.lit, f.skip_ancestor_ids))) & ~id_.isin(*f.skip_ancestor_ids)
    return keep


def wiki_query(f: WikiFilter) -> str:
    """The same condition in the wiki's query language, newest pages first."""
    group = lambda names: ", ".join(f'"{n}"' for n in names)
    terms = ["type = page"]
    if f.ancestor_ids:
        terms.append(f"(ancestor in ({group(f.ancestor_ids)}) OR id in ({group(f.ancestor_ids)}))")
    elif f.spaces:
        terms.append(f"space in ({group(f.spaces)})")
    if f.skip_ancestor_ids:
        terms += [f"ancestor not in ({group(f.skip_ancestor_ids)})", f"id not in ({group(f.skip_ancestor_ids)})"]
    return " AND ".join(terms) + " ORDER BY lastmodified DESC"


def fetch_pages(get: Callable[[int, int], list[str]], size: int = PAGE_SIZE) -> list[str]:
    """All results of a paged service as JSON texts; the first short page is the last."""
    out: list[str] = []
    while True:
        got = get(len(out), size)
        out += got
        if len(got) < size:
            return out


def page_number(order: Column, size: int = PAGE_SIZE) -> Column:
    """The page on which a result numbered from 0 comes."""
    return F.floor(order / size).cast("bigint")


def wiki_documents(pages: DataFrame, json: str = "json", describe: Describe | None = None) -> DataFrame:
    """Documents from pages as JSON texts; pages without an id are left out."""
    both = pages.select(F.from_json(json, f"content struct<{PAGE.replace(' string', ':string').replace(' struct', ':struct')}>").alias("w"), F.from_json(json, PAGE).alias("f"))
    p = both.select(F.coalesce("w.content", "f").alias("p")).filter("p.id IS NOT NULL")
    body = markdown(F.coalesce("p.body.view.value", F.lit("")), describe)
    text = F.concat(F.lit("# "), F.coalesce("p.title", F.lit("")), F.lit("\n\n"), F.col("__body"))
    out = p.withColumn("__body", body).withColumn("text", text)
    return out.select(
        F.col("p.id").alias("id"), F.concat(F.coalesce("p.space.key", F.lit("UNKNOWN")), F.lit("/"), F.coalesce("p.title", F.lit(""))).alias("path"), "text",
        iso_time(F.coalesce("p.history.lastUpdated.when", F.lit(""))).alias("updated_at"), F.lit("confluence").alias("source_type"), F.octet_length("text").cast("bigint").alias("size"),
        F.nullif(F.col("p.history.createdBy.displayName"), F.lit("")).alias("creator"), F.try_to_timestamp(F.coalesce("p.history.createdDate", "p.history.createdAt")).alias("created_at"),
    )
