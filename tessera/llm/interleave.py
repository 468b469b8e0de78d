"""Media columns: interleaved sequences of text and media references.

HTML is parsed into ordered items, either text or a media reference with its caption.
A reference names its payload by digest; a digest join resolves it against a media
store, and positions and captions stay aligned because the join keeps the item's place.
The store keeps one row per digest, so copies are stored and joined once. Payloads are
held as 8-bit grey PNG images, 64 samples a row, which is lossless for any bytes whose
length is a positive multiple of 64.

Defined results: a null or empty HTML gives no items; a reference whose digest the store
lacks keeps its place with null media columns; repeated rows give repeated rows; an empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_col

ROW = 64
#: Fixed values of the PNG format.
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BREAKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "article", "section", "tr", "br"}


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.caption = False

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.words)).strip()
        self.words = []
        if not text:
            return
        if self.caption and self.items and self.items[-1]["kind"] == "media":
            last = self.items[-1]
            last["caption"] = f"{last['caption']} {text}".strip() if last["caption"] else text
        else:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS or tag == "img":
            self.flush()
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figcaption":
            self.caption = True
        elif tag == "img":
            a = dict(attrs)
            source = a.get("src") or ""
            self.items.append({"kind": "media", "text": None, "digest": source.rpartition("sha256:")[2].lower() if "sha256:" in source else None, "caption": (a.get("alt") or "").strip() or None})

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self.flush()
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.caption = False

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def html_items(html: str | None) -> list[dict]:
    """The ordered text and media items of one page."""
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"pos": i, **x} for i, x in enumerate(parser.items)]


def interleaved(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row per item: `id_col`, pos, kind, text, digest, caption."""

    @F.arrow_udf(ITEMS)
    def items(html: pa.Array) -> pa.Array:
        return pa.array([html_items(x) for x in html.to_pylist()], pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])))

    return pages.select(F.col(id_col), F.explode(items(F.col(html_col).cast("string"))).alias("item")).select(id_col, "item.*")


def to_png(payload: bytes) -> bytes:
    """Bytes, a positive multiple of 64 of them, as an 8-bit grey PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that `to_png` wrote; checks every chunk's sum."""
    if media[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at, width, height, data = 8, 0, 0, []
    while at < len(media):
        n = struct.unpack(">I", media[at : at + 4])[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:].tobytes()


def padded(text: Column) -> Column:
    """UTF-8 bytes of a text, then bytes 0 up to a positive multiple of 64."""
    raw = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    fill = F.when(n == 0, F.lit(ROW)).otherwise(F.pmod(-n, F.lit(ROW)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), fill)))


def media_store(payloads: DataFrame, payload_col: str = "payload", digest_col: str = "digest") -> DataFrame:
    """digest, media: every payload in its stored form."""

    def encode(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_png(x) for x in b.column(1).to_pylist()], pa.binary())], names=["digest", "media"])

    return payloads.select(F.col(digest_col).alias("digest"), F.col(payload_col).alias("payload")).mapInArrow(encode, "digest string, media binary")


def feature(payload: bytes) -> str:
    """Mean, deviation and a 16-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    return f"grey8;{ROW}x{len(x) // ROW};mean={x.mean():.4f};std={x.std():.4f};hist={','.join(map(str, bins))}"


def media_features(store: DataFrame) -> DataFrame:
    """What is read back from the stored form: a row per stored row, without the bytes themselves."""
    out = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def decode(batches):
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload = from_png(media)
                rows.append({"digest": digest, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-ROW:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(payload)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))

    return store.select("digest", "media").mapInArrow(decode, out)


def resolve(items: DataFrame, store: DataFrame) -> DataFrame:
    """Items with the columns of the store's row of the same digest; text items and unknown digests get nulls.

    The store is brought to one row per digest before the join, the least of several, so a digest that a third
    of all items name is one row on that side, and AQE splits the other side. Items without a digest stay out of the join.
    """
    rest = [c for c in store.columns if c != "digest"]
    one = store.groupBy("digest").agg(F.min(F.struct(*rest)).alias("media_row"))
    named = items.filter("digest IS NOT NULL")
    found = named.join(one, "digest", "left").select(*[named[c] for c in items.columns], *[F.col("media_row")[c].alias(c) for c in rest])
    return found.unionByName(items.filter("digest IS NULL").select("*", *[F.lit(None).cast(store.schema[c].dataType).alias(c) for c in rest]))


def document_pages(base: DataFrame) -> DataFrame:
    """owner, html: every document as a page of text and two captioned references to its payload, one behind the text and one at the end."""
    ref = lambda caption: F.concat(F.lit('<figure><img src="sha256:'), "digest", F.lit(f'"><figcaption>{caption} '), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.lit("</figcaption></figure>"))
    said = F.concat(F.lit("<p>"), F.octet_length("text").cast("string"), F.lit(" bytes</p>"))
    owner = F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).alias("owner")
    return base.select(owner, F.concat(F.lit("<article>"), said, ref("document"), F.lit("<p>the same again</p>"), ref("copy of"), F.lit("</article>")).alias("html"))


def document_media(docs: DataFrame) -> DataFrame:
    """Every document's first reference with what its stored payload reads back as.

    Payloads are encoded and decoded where the documents lie, copies included, so that no payload is shuffled; only
    features are, and of these one row per digest is kept before the join.
    """
    base = docs.select("doc_id", text_col().alias("text")).withColumn("payload", padded(F.col("text"))).withColumn("digest", F.sha2("payload", 256))
    found = resolve(interleaved(document_pages(base), "owner", "html"), media_features(media_store(base))).filter("kind = 'media' AND pos = 1")
    return found.select("owner.doc_id", "owner.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(read_table(spark, sf_dir, "documents"))
