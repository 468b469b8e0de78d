"""python -m tessera.cli --config FILE [--store DIR] [-v] index | query QUESTION [--top-k N] | split FILE [--limit N] | serve [--port N]"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config, RetrievalConfig, load_config
from tessera.functions import media_types
from tessera.models import ChatClient, describer
from tessera.operators import embed, retrieve, split, store
from tessera.plans.index import Indexer
from tessera.plans.rag import search
from tessera.services import dense_service, server, sparse_service
from tessera.ship import ship
from tessera.sources.readers import markdown_files
from tessera.sources.wiki import downloader, wiki_pages

LOG = logging.getLogger("tessera")


def chat(c) -> ChatClient | None:
    return ChatClient(c.url, c.model, c.key) if c.url else None


def models(config: Config) -> dict:
    """The configured services, or the stand-ins."""
    return {"embed": dense_service(config.dense_url) if config.dense_url else embed.hashed_embedding, "weigh": sparse_service(config.sparse_url) if config.sparse_url else embed.counted_words}


def sources(spark: SparkSession, config: Config) -> list[DataFrame]:
    out = []
    if config.local_documents:
        LOG.info("source: documents below %s", config.local_documents)
        out.append(markdown_files(spark, config.local_documents))
    if config.wiki.url:
        vision = chat(config.vision)
        LOG.info("source: wiki %s, pictures %s", config.wiki.url, "described" if vision else "linked")
        out.append(wiki_pages(spark, config.wiki, describer(vision, downloader(config.wiki), media_types) if vision else None))
    return out


def index(spark: SparkSession, config: Config, base: str) -> DataFrame:
    """One source after another; both tables switch together, by one pointer."""
    found = sources(spark, config)
    if not found:
        raise SystemExit("no sources are configured")
    indexer = Indexer(config.index, model=chat(config.llm), **models(config))
    reports = []
    for source in found:
        now = store.Current.read(spark, base)
        todo, docs, chunks = indexer.run(source, now.documents, now.chunks)
        todo = todo.groupBy("action").count()
        reports.append(spark.createDataFrame(todo.collect(), todo.schema))  # three rows at most
        now.replace(docs, chunks)
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out.groupBy("action").agg(F.sum("count").alias("count"))


def query(spark: SparkSession, base: str, question: str, config: RetrievalConfig, embed_model: embed.Embed = embed.hashed_embedding, weigh: embed.Weigh = embed.counted_words) -> DataFrame:
    """Hybrid search over the stored vectors, without an answer."""
    chunks = store.Current.read(spark, base).chunks
    intents = spark.createDataFrame([(0, question)], "conv_id int, intent string")
    shown = chunks.select("id", "path", "order", "text", "updated_at", F.get_json_object("payload", "$.creator").alias("creator"))
    found = search(intents, chunks, chunks.select("id", "keywords"), config, embed_model, weigh).join(shown, "id")
    return retrieve.report(found).select("rank", "score", "path", "order", "creator", "updated_at", "preview").orderBy("rank")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--config", default="config.yml")
    p.add_argument("--store", default="store")
    p.add_argument("-v", "--debug", action="store_true", help="tell more, model answers included")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index", help="bring the index up to date with the sources")
    q = sub.add_parser("query", help="hybrid search without an answer")
    q.add_argument("question")
    q.add_argument("--top-k", type=int, default=10)
    d = sub.add_parser("split", help="show how a text is split")
    d.add_argument("file")
    d.add_argument("--limit", type=int, default=512)
    s = sub.add_parser("serve", help="serve the stand-in representations over HTTP")
    s.add_argument("--port", type=int, default=8000)
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)-8s %(name)s %(message)s", datefmt="%H:%M:%S")
    LOG.setLevel(logging.DEBUG if a.debug else logging.INFO)
    if a.command == "split":
        with open(a.file, encoding="utf-8") as f:
            for i, part in enumerate(split.recursive(f.read(), a.limit)):
                print(f"--- {i}: {split.count_tokens(part)} tokens\n{part}")
        return
    if a.command == "serve":
        server(a.port, embed.hashed_embedding, embed.counted_words, "stand-in").serve_forever()
        return
    config = load_config(a.config)
    spark = ship(SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    if a.command == "index":
        index(spark, config, a.store).show()
    else:
        use = models(config)
        query(spark, a.store, a.question, RetrievalConfig(top_k=a.top_k), use["embed"], use["weigh"]).show(a.top_k, truncate=False)


if __name__ == "__main__":
    main()
