"""Column builders: every function returns an expression that Catalyst plans and compiles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The modulus of token indices and the namespace of document point ids.
INDEX_MODULUS = 4294967295
POINT_NAMESPACE = "a1b2c3d4e5f67890abcdef1234567890"
#: Media types by the extension of a path.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "ico": "image/vnd.microsoft.icon"}


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def token_hash(c: Column) -> Column:
    """MD5 as a number modulo 2**32 - 1: 2**32 is 1 under it, so the four 32-bit words add up."""
    words = [F.conv(F.substring(F.md5(c), k, 8), 16, 10).cast("bigint") for k in (1, 9, 17, 25)]
    return (words[0] + words[1] + words[2] + words[3]) % F.lit(INDEX_MODULUS)


def point_id(c: Column) -> Column:
    """Version-5 UUID of a document id."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), F.encode(c, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def token_count(c: Column) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(F.char_length(c) / 4.0).cast("bigint")


def fits(c: Column, limit: int) -> Column:
    return token_count(c) <= F.lit(limit)


def sentences(c: Column) -> Column:
    """Cut behind a full stop, question or exclamation mark that white space follows."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])(?U:\s+)"), strip), lambda x: x != "")


def header_blocks(c: Column) -> Column:
    """Cut before each Markdown heading; texts with fewer than two headings stay whole."""
    cut = F.filter(F.transform(F.split(c, r"(?mdU)(?=^#{1,6}[^\S\n])"), strip), lambda x: x != "")
    return F.when(F.regexp_count(c, F.lit(r"(?mdU)^#{1,6}\s")) > 1, cut).otherwise(F.array(c))


def char_slices(c: Column, limit: int) -> Column:
    """Slices of four characters for each token of the limit; none of an empty text."""
    n = max(1, 4 * limit)
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(c) - 1, F.lit(0)), F.lit(n))
    return F.when(F.char_length(c) > 0, F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def pack(blocks: Column, limit: int) -> Column:
    """Neighbouring blocks together up to `limit` tokens; a larger block is alone."""
    start = F.struct(F.array().cast("array<array<string>>").alias("packs"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, b: Column) -> Column:
        n = token_count(b)
        full = (acc["n"] + n > limit) & (F.size(acc["open"]) > 0)
        return F.struct(
            F.when(full, F.concat(acc["packs"], F.array(acc["open"]))).otherwise(acc["packs"]).alias("packs"),
            F.when(full, F.array(b)).otherwise(F.concat(acc["open"], F.array(b))).alias("open"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(blocks, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["packs"], F.array(acc["open"]))).otherwise(acc["packs"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def media_type(url: Column) -> Column:
    """By the extension of the URL's path; image/png if unknown."""
    path = F.regexp_extract(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1)
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(known[F.lower(path)], F.lit("image/png"))


def media_types(url: str) -> str:
    """The same for one address."""
    path = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|[?#].*$", "", url)
    return MEDIA_TYPES.get(path.rpartition("/")[2].rpartition(".")[2].lower(), "image/png")


def iso_time(c: Column, otherwise: Column | None = None) -> Column:
    """An ISO date with time as a UTC timestamp; empty or invalid text gives `otherwise` (default: now)."""
    day, clock = r"\d{4}-?\d{2}-?\d{2}", r"[T ]\d{2}:?\d{2}(:?\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?"
    fine = c.rlike(rf"^{day}({clock})?$")
    long = F.regexp_replace(F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"), r"([T ]\d{2})(\d{2})", "$1:$2")  # the compact form's marks
    long = F.regexp_replace(F.regexp_replace(F.regexp_replace(long, r"([T ]\d{2}:\d{2})(\d{2})", "$1:$2"), ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    long = F.regexp_replace(F.regexp_replace(long, r"([T ].*[+-]\d{2})$", "$1:00"), r"(\.\d{6})\d+", "$1")
    return F.coalesce(F.when(fine, F.try_to_timestamp(long)), F.current_timestamp() if otherwise is None else otherwise)


def verdict_keep(v: Column) -> Column:
    """A judge's answer keeps a chunk unless it starts with 0."""
    return ~F.startswith(v, F.lit("0"))


def verdict_comment(v: Column) -> Column:
    """What follows the first bar, or the whole answer."""
    at = F.instr(v, "|")
    return strip(F.when(at > 0, F.substring(v, at + 1, F.char_length(v))).otherwise(v))


def display_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def merged(base: Column, over: Column) -> Column:
    """Two string maps as one; where both have a key, `over` counts."""
    empty = F.create_map().cast("map<string,string>")
    base, over = F.coalesce(base, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def without_keys(m: Column, keys: list[str]) -> Column:
    """A map without some of its keys."""
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def url_join(base: Column, ref: Column) -> Column:
    """A reference as an absolute address: whole ones stay, //host takes the scheme, /path the host, ?query the page, other paths the base's folder."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == host, F.concat(host, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    rest = F.substr(ref, F.char_length(path) + 1)
    whole = F.substr(F.concat(folder, path), F.char_length(host) + 1)
    # . and .. are taken out one after another
    start = F.array().cast("array<string>")
    parts = F.split(F.substring(whole, 2, 1 << 30), "/")
    kept = F.aggregate(parts, start, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    tail = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    plain = F.concat(host, F.lit("/"), F.array_join(kept, "/"), tail, rest)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref == "", base).when(F.startswith(ref, F.lit("//")), F.concat(scheme, ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(host, ref)).when(F.startswith(ref, F.lit("?")), F.concat(page, ref))
        .when(F.startswith(ref, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), ref)).otherwise(plain)
    )
