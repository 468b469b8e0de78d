"""A wiki's pages as a data source: spark.read.format("wiki").options(url=..., query=..., user=..., secret=...).load().

The first request asks how many pages there are; each partition then reads one range of places, so no process holds all pages.
A service that doesn't say how many is read by one partition, page by page.
"""

from __future__ import annotations

import base64
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.config import WikiConfig
from tessera.sources.html import Describe
from tessera.sources.readers import PAGE_SIZE, wiki_documents, wiki_query

FIELDS = "content.body.view,content.history.lastUpdated,content.history.createdBy,content.history.createdDate,content.space"


def opened(url: str, user: str, secret: str, timeout: float = 30):
    """The response to an authorised request."""
    mark = base64.b64encode(f"{user}:{secret}".encode()).decode()
    return urllib.request.urlopen(urllib.request.Request(url, headers={"Authorization": f"Basic {mark}", "Accept": "application/json, */*"}), timeout=timeout)


def results(options: dict, start: int, size: int) -> dict:
    """One page of search results."""
    ask = urllib.parse.urlencode({"cql": options["query"], "start": start, "limit": size, "expand": options.get("expand", FIELDS)})
    with opened(f"{options['url'].rstrip('/')}/rest/api/search?{ask}", options.get("user", ""), options["secret"], float(options.get("timeout", 30))) as r:
        return json.load(r)


class Places(InputPartition):
    """Results from `start` on: `many` of them, or all that follow."""

    def __init__(self, start: int, many: int | None) -> None:
        self.start, self.many = start, many


class WikiReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        if not self.options.get("secret"):
            raise ValueError("a wiki needs a secret: a password or a token")
        self.size = int(self.options.get("pagesize", PAGE_SIZE))

    def partitions(self) -> list[Places]:
        total = results(self.options, 0, 1).get("totalSize")
        return [Places(0, None)] if total is None else [Places(s, self.size) for s in range(0, int(total), self.size)]

    def read(self, places: Places) -> Iterator[tuple[str]]:
        start = places.start
        while True:
            found = results(self.options, start, self.size).get("results", [])
            yield from ((json.dumps(x, ensure_ascii=False),) for x in found)
            start += len(found)
            if places.many is not None or len(found) < self.size:
                return


class Wiki(DataSource):
    """One column, json, with a page each."""

    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self) -> str:
        return "json string"

    def reader(self, schema) -> WikiReader:
        return WikiReader(dict(self.options))


def downloader(config: WikiConfig, timeout: float = 10) -> Callable[[str], bytes | None]:
    """A function from an image's address, absolute or within the wiki, to its bytes; nothing if it can't be had. The wiki's secret goes to the wiki's host only."""
    home = urllib.parse.urlsplit(config.url)

    def download(src: str) -> bytes | None:
        url = src if src.startswith("http") else urllib.parse.urljoin(config.url, src)
        own = urllib.parse.urlsplit(url).netloc == home.netloc
        try:
            with opened(url, config.user, config.secret, timeout) if own else urllib.request.urlopen(url, timeout=timeout) as r:
                return r.read()
        except (OSError, ValueError):
            return None

    return download


def wiki_pages(spark: SparkSession, config: WikiConfig, describe: Describe | None = None) -> DataFrame:
    """Documents of all pages that the configured filter lets through."""
    spark.dataSource.register(Wiki)
    found = spark.read.format("wiki").options(url=config.url, user=config.user, secret=config.secret, query=wiki_query(config.filter)).load()
    return wiki_documents(found, "json", describe)
