"""Dense and sparse representations; models are injected, deterministic stand-ins serve offline."""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import INDEX_MODULUS, strip, token_hash

#: What the dense model wants before documents and queries.
DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "

Embed = Callable[[list[str]], list[list[float]]]
#: A sparse model: of every text its tokens with their weights.
Weigh = Callable[[list[str]], list[dict[str, float]]]


class Known(dict):
    """A function's values by word; once `most` are kept, others are worked out each time, so that what came early, as frequent words do, stays."""

    def __init__(self, value: Callable[[str], int], most: int = 1 << 18) -> None:
        self.value, self.most = value, most

    def __missing__(self, word: str) -> int:
        found = self.value(word)
        if len(self) < self.most:
            self[word] = found
        return found


CHECKSUMS = Known(lambda word: zlib.crc32(word.encode()))


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Stand-in for a dense model: signed word counts in `dim` buckets."""
    words = [t.lower().split() for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(x) for x in words])
    h = np.fromiter(map(CHECKSUMS.__getitem__, chain.from_iterable(words)), np.int64, len(row))
    return np.bincount(row * dim + h % dim, (h >> 31) * 2.0 - 1.0, len(texts) * dim).reshape(len(texts), dim).tolist()


def dense_model(name: str) -> Embed:
    """A sentence-transformers model, loaded once per worker; the package is needed there only."""
    held: list = []

    def run(texts: list[str]) -> list[list[float]]:
        if not held:
            from sentence_transformers import SentenceTransformer

            held.append(SentenceTransformer(name))
        return held[0].encode(texts, normalize_embeddings=False).tolist()

    return run


def counted_words(texts: list[str]) -> list[dict[str, float]]:
    """Stand-in for a sparse model: how often each blank-separated word occurs."""
    return [{w: float(n) for w, n in Counter(t.split()).items()} for t in texts]


def token_weights(ids: list[int], weights: list[float], special: set[int], decode: Callable[[int], str]) -> dict[str, float]:
    """A model's positive weights by decoded token, the largest of each; special tokens have none."""
    out: dict[str, float] = {}
    for i, w in zip(ids, weights, strict=True):
        if i not in special and w > 0:
            tok = decode(i).strip()
            out[tok] = max(out.get(tok, 0.0), float(w))
    return out


def sparse_model(name: str, device: str | None = None, longest: int = 8192) -> Weigh:
    """A token classification model that weighs tokens, loaded once per worker; transformers and torch are needed there only."""
    held: list = []

    def run(texts: list[str]) -> list[dict[str, float]]:
        import torch
        from transformers import AutoModelForTokenClassification, AutoTokenizer

        if not held:
            where = torch.device(device or ("cuda" if torch.cuda.is_available() else "cpu"))
            kind = torch.float16 if where.type == "cuda" else torch.float32
            held[:] = [AutoTokenizer.from_pretrained(name, trust_remote_code=True), AutoModelForTokenClassification.from_pretrained(name, trust_remote_code=True, torch_dtype=kind).to(where).eval()]
        tokenizer, model = held
        special = {getattr(tokenizer, f"{k}_token_id", None) for k in ("cls", "eos", "pad", "unk")} - {None}
        out = []
        for t in texts:
            enc = {k: v.to(model.device) for k, v in tokenizer(t, return_tensors="pt", truncation=True, max_length=longest).items()}
            enc["position_ids"] = torch.arange(enc["input_ids"].shape[1], device=model.device).unsqueeze(0)
            with torch.no_grad():
                w = torch.relu(model(**enc, return_dict=True).logits).squeeze(-1)[0].cpu().tolist()
            out.append(token_weights(enc["input_ids"][0].tolist(), w, special, lambda i: tokenizer.decode([i], skip_special_tokens=True)))
        return out

    return run


@functools.lru_cache(1 << 18)
def index_of(token: str) -> int:
    """The same number as functions.token_hash."""
    return int.from_bytes(hashlib.md5(token.encode()).digest()) % INDEX_MODULUS


def sparse_of(weights: dict[str, float]) -> dict[str, list]:
    """Indices, ascending, and values of a token-to-weight map; of tokens with one index the larger weight counts."""
    by: dict[int, float] = {}
    for tok, w in weights.items():
        i = index_of(tok)
        by[i] = max(by.get(i, float("-inf")), w)
    return {"indices": sorted(by), "values": [by[i] for i in sorted(by)]}


def sparse(c: Column, weigh: Weigh = counted_words, kind: str = "float") -> Column:
    """Sparse vectors of a text column in batches, with values of that kind, float or double."""

    @F.arrow_udf(f"struct<indices:array<bigint>,values:array<{kind}>>")
    def run(texts: pa.Array) -> pa.Array:
        start, idx, w = entries(weigh([t or "" for t in texts.to_pylist()]))
        values = pa.array(w.astype(np.float32), pa.float32()) if kind == "float" else pa.array(w, pa.float64())
        lists = [pa.ListArray.from_arrays(pa.array(start, pa.int32()), x) for x in (pa.array(idx, pa.int64()), values)]
        return pa.StructArray.from_arrays(lists, names=["indices", "values"])

    return run(c)


INDICES = Known(index_of.__wrapped__)


def entries(maps: list[dict[str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sparse_of for many maps at once: where each begins (and the end), indices and values."""
    each = np.fromiter(map(len, maps), np.int64, len(maps))
    n = int(each.sum())
    idx = np.fromiter(map(INDICES.__getitem__, chain.from_iterable(maps)), np.uint64, n)
    w = np.fromiter(chain.from_iterable(m.values() for m in maps), np.float64, n)
    key = np.repeat(np.arange(len(maps), dtype=np.uint64) << np.uint64(32), each) | idx
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    if not new.all():  # tokens with one index
        w, key = np.maximum.reduceat(w, np.flatnonzero(new)), key[new]
    start = np.searchsorted(key, np.arange(len(maps) + 1, dtype=np.uint64) << np.uint64(32))
    return start, (key & np.uint64(0xFFFFFFFF)).astype(np.int64), w


def postings_of(chunks: DataFrame) -> DataFrame:
    """id, idx, w from stored sparse vectors (id, keywords)."""
    pairs = F.arrays_zip(F.col("keywords.indices").alias("idx"), F.col("keywords.values").alias("w"))
    return chunks.select("id", F.explode(pairs).alias("p")).select("id", F.col("p.idx").alias("idx"), F.col("p.w").cast("double").alias("w"))


def metadata_payload(creator: Column, created_at: Column) -> Column:
    """JSON of a document's author and time of creation; what is null is left out."""
    return F.to_json(F.struct(creator.alias("creator"), F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ssxxx").alias("created_at")))


def dense(c: Column, embed: Embed = hashed_embedding, prefix: str = DOCUMENT_PREFIX) -> Column:
    """Vectors of a text column in batches; `embed` may load its model once per worker."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(embed([prefix + (t or "") for t in texts.to_pylist()]), pa.list_(pa.float32()))

    return run(c)


def dense_text() -> Column:
    """What a chunk's dense vector stands for: its path, text and context."""
    return F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("path", "text", "context")])


def sparse_rows(tokens: DataFrame, key: str, special: tuple[str, ...] = ()) -> DataFrame:
    """key, idx, w from key, tok, w: the largest positive weight per token, then per hash."""
    kept = tokens.filter((F.col("w") > 0) & ~F.col("tok").isin(*special) if special else F.col("w") > 0)
    per_token = kept.groupBy(key, strip(F.col("tok")).alias("tok")).agg(F.max("w").alias("w"))
    return per_token.groupBy(key, token_hash(F.col("tok")).alias("idx")).agg(F.max("w").alias("w"))


def sparse_largest(docs: DataFrame, key: str, text: str, weigh: Weigh) -> DataFrame:
    """The same as sparse_rows from texts, a null one having no tokens: made where the text lies; only rows of keys that occur several times meet."""
    told = docs.filter(F.col(text).isNotNull()).select(key, sparse(F.col(text), weigh, "double").alias("v"))
    rows = lambda d: d.select(key, F.explode(F.arrays_zip(F.col("v.indices").alias("idx"), F.col("v.values").alias("w"))).alias("p")).select(key, "p.idx", "p.w")
    twice = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("__k"))
    if twice.isEmpty():
        return rows(told)
    same = F.col(key).eqNullSafe(F.col("__k"))
    return rows(told.join(twice, same, "left_anti")).unionByName(rows(told.join(twice, same, "left_semi")).groupBy(key, "idx").agg(F.max("w").alias("w")))


def sparse_vectors(rows: DataFrame, key: str) -> DataFrame:
    """key, keywords: struct of indices and values in the order of indices."""
    pairs = F.sort_array(F.collect_list(F.struct("idx", "w")))
    return rows.groupBy(key).agg(pairs.alias("p")).select(key, F.struct(F.transform("p", lambda x: x["idx"]).alias("indices"), F.transform("p", lambda x: x["w"].cast("float")).alias("values")).alias("keywords"))


def encode_vector(c: Column) -> Column:
    """Vectors as base64 of little-endian 32-bit floats."""

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode() for x in v.to_pylist()], pa.string())

    return run(c)


def decode_vector(c: Column) -> Column:
    @F.arrow_udf("array<float>")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.frombuffer(base64.b64decode(x), "<f4").tolist() for x in v.to_pylist()], pa.list_(pa.float32()))

    return run(c)
