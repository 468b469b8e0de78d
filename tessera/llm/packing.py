"""Best-fit packing of tokenised documents into sequences, improved by swaps.

1. Documents are tokenised where they lie; only piece lengths and checksums leave the task.
2. Lengths are at most `limit`, so the whole corpus is described by a histogram of at most
   `limit` counts, whatever its size. Best-fit decreasing runs on it in groups of equal bins.
3. Local search works on all underfull bins, in groups of equal ones: it moves a document, exchanges one for one
   or two for one whenever that raises the sum of squared fills, until no such step is left.
4. Pieces take the places of their length in the order of their rank, which is counted within
   hash buckets and added up over the buckets, so no task holds all pieces of one length.

Defined results: a null text is an empty text (one token, the end mark); a null doc_id stays
null; repeated rows are packed each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stage, text_col
from .kernels import begin, kept, tidy

LIMIT, CACHE = 2048, 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Letters, numbers and white space below U+0250, as Unicode has them.
LETTERS, NUMBERS, SPACES = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \u0085 "
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Texts with other characters, or with the vocabulary's special tokens, go whole through the tokenizer.
UNUSUAL = re.compile(r"[^\t-\r -~ -įĲ-ɏ‐-‧‰-⁞€]|<\|")

_loaded: dict[str, tuple] = kept.setdefault("packing", {})


def token_bytes(texts: list[str], vocabulary: str) -> list[bytes]:
    """Token ids of each text as little-endian 32-bit numbers, equal to the tokenizer's own.

    The vocabulary splits a text into words before it merges, so a word's ids don't depend on its
    neighbours: new words are given to the tokenizer, and two tables of CACHE words keep their ids. When the first is
    full, it takes the second's place, whose words are forgotten unless they were met since: frequent words stay.
    """
    if vocabulary not in _loaded:
        from tokenizers import Tokenizer

        _loaded[vocabulary] = (Tokenizer.from_file(vocabulary), {}, {})
    tokenizer, known, old = _loaded[vocabulary]
    out: list[bytes] = []
    for text in texts:
        if UNUSUAL.search(text):
            out.append(np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            continue
        words = WORD.findall((text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).lower())
        new = set(words).difference(known)
        if new and old:
            again = {w: old[w] for w in new if w in old}
            known.update(again)
            new.difference_update(again)
        if new:
            listed = list(new)
            found = tokenizer.encode(" ".join(listed), add_special_tokens=False)
            ids, of = np.array(found.ids, "<u4"), np.array(found.word_ids)
            cuts = (np.searchsorted(of, np.arange(len(listed) + 1)) * 4).tolist()
            flat = ids.tobytes()
            known.update(zip(listed, [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        out.append(b"".join(map(known.__getitem__, words)))
        if len(known) > CACHE:
            known, old = {}, known
            _loaded[vocabulary] = (tokenizer, known, old)
    return out


def forget(vocabulary: str) -> None:
    """Leaves one table of words between tasks, the newer one if it is half full; the first task of another operator drops it (`begin`)."""
    if vocabulary in _loaded:
        tokenizer, known, old = _loaded[vocabulary]
        _loaded[vocabulary] = (tokenizer, known if len(known) > CACHE // 2 or not old else old, {})


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: only documents over the limit are cut."""

    def cut(batches):
        begin("packing")
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                flat = token_bytes([text.as_py()], vocabulary)[0] + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(flat), 4 * limit)):
                    part = flat[at : at + 4 * limit]
                    for c, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        forget(vocabulary)
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).mapInArrow(cut, PIECES)


class Bins:
    """Groups of equal bins: how many, and the lengths in each."""

    def __init__(self, limit: int) -> None:
        self.limit, self.groups = limit, []
        self.by_room: dict[int, list[int]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, count: int, items: list[tuple[int, int]]) -> None:
        """items: (length, how many of it)."""
        room = self.limit - sum(a * n for a, n in items)
        self.groups.append((count, items, room))
        if room:
            if not self.by_room[room]:
                insort(self.rooms, room)
            self.by_room[room].append(len(self.groups) - 1)

    def take(self, room: int) -> int:
        at = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms.pop(bisect_left(self.rooms, room))
        return at

    def put(self, length: int, n: int) -> None:
        """Best fit for n pieces of one length: the fullest bins with room first, then new ones."""
        while n:
            k = bisect_left(self.rooms, length)
            count, items, room = (n, [], self.limit)
            if k < len(self.rooms):
                room = self.rooms[k]
                at = self.take(room)
                count, items, _ = self.groups[at]
                self.groups[at] = (0, [], 0)
            each = min(room // length, n)
            full = min(count, n // each)
            self.add(full, [*items, (length, each)])
            if items and count > full:
                self.add(count - full, items)
            n -= full * each


class Underfull:
    """Groups of equal bins with room: found by what leaves a bin (nothing, one piece or two, as a sum) and by room."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.count: dict[tuple, int] = {}
        self.sums: dict[tuple, np.ndarray] = {}
        self.by_room: dict[int, dict[tuple, None]] = defaultdict(dict)
        self.have = np.zeros((limit + 1, limit + 1), np.int32)  # sum, room: how many groups
        self.most = np.full(limit + 1, -1, np.int64)  # sum: the largest room of a group with it

    def room(self, items: tuple) -> int:
        return self.limit - sum(a * k for a, k in items)

    def add(self, items: tuple, n: int) -> None:
        if items in self.count:
            self.count[items] += n
            return
        one = np.array([a for a, _ in items], np.int64)
        twice = np.array([a for a, k in items if k > 1], np.int64)
        i, j = np.triu_indices(len(one), 1)
        sums, room = np.unique(np.concatenate([[0], one, one[i] + one[j], 2 * twice]).astype(np.int64)), self.room(items)
        self.count[items], self.sums[items] = n, sums
        self.by_room[room][items] = None
        self.have[sums, room] += 1
        self.most[sums] = np.maximum(self.most[sums], room)

    def take(self, items: tuple, n: int) -> None:
        self.count[items] -= n
        if self.count[items]:
            return
        sums, room = self.sums.pop(items), self.room(items)
        del self.count[items], self.by_room[room][items]
        self.have[sums, room] -= 1
        for s in sums[(self.have[sums, room] == 0) & (self.most[sums] == room)].tolist():
            left = np.flatnonzero(self.have[s, : room + 1])
            self.most[s] = left[-1] if len(left) else -1

    def target(self, items: tuple) -> tuple[int, tuple, int] | None:
        """The piece that leaves a bin of `items`, the group that takes it and the sum that comes back, if that raises the sum of squared fills: the largest gain of the largest piece that has one."""
        room = self.room(items)
        for a, _ in items:
            for s in np.flatnonzero(self.most[:a] >= a - np.arange(a)).tolist():
                gain = a - s
                for r in (np.flatnonzero(self.have[s, gain : min(self.limit, room + gain - 1) + 1]) + gain).tolist():
                    for t in self.by_room[r]:
                        if (t != items or self.count[t] > 1) and (at := np.searchsorted(self.sums[t], s)) < len(self.sums[t]) and self.sums[t][at] == s:
                            return a, t, s
        return None


def parts(items: tuple, s: int) -> list[int]:
    """No piece, one or two of a bin with that sum."""
    have = dict(items)
    if not s or s in have:
        return [s] if s else []
    return next([a, s - a] for a, k in items if s - a in have and (s - a != a or k > 1))


def exchanged(items: tuple, out: list[int], new: list[int]) -> tuple:
    have = dict(items)
    for x in out:
        have[x] -= 1
    for x in new:
        have[x] = have.get(x, 0) + 1
    return tuple(sorted(((a, k) for a, k in have.items() if k), reverse=True))


def exchange(groups: dict[tuple, int], limit: int, least: int) -> dict[tuple, int]:
    """Swap-based local search over groups of equal bins (((length, how many of it), ...): how many bins).

    Each step does the same to as many bins as two groups allow, and raises the sum of squared fills or empties bins. It ends
    when no move of a piece and no exchange of one for one or two improves any bin, or with `least` bins, which no layout undercuts.
    """
    open_, full, bins = Underfull(limit), defaultdict(int), sum(groups.values())
    for items, n in groups.items():
        if open_.room(items):
            open_.add(items, n)
        else:
            full[items] += n
    moved = True
    while moved and bins > least:
        moved = False
        for first in sorted(open_.count, key=open_.room, reverse=True):
            d = first
            while bins > least and d in open_.count and (found := open_.target(d)):
                moved = True
                a, t, s = found
                back = parts(t, s)
                n = open_.count[d] // 2 if t == d else min(open_.count[d], open_.count[t])
                open_.take(d, n)
                open_.take(t, n)
                less, more = exchanged(d, [a], back), exchanged(t, back, [a])
                for items in (less, more):
                    if not items:
                        bins -= n
                    elif open_.room(items):
                        open_.add(items, n)
                    else:
                        full[items] += n
                if d not in open_.count:
                    d = less
    for items, n in open_.count.items():
        full[items] += n
    return dict(full)


def improve(bins: list[list[int]], limit: int, least: int) -> list[list[int]]:
    """The local search for bins that are listed one by one."""
    groups: dict[tuple, int] = defaultdict(int)
    for b in bins:
        groups[exchanged((), [], b)] += 1
    return [[a for a, k in items for _ in range(k)] for items, n in exchange(groups, limit, least).items() for _ in range(n)]


def layout(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups (how many bins, [(length, how many of it in each)]) for a histogram of lengths."""
    bins = Bins(limit)
    for length in sorted(histogram, reverse=True):
        bins.put(length, histogram[length])
    groups: dict[tuple, int] = defaultdict(int)
    for c, items, _ in bins.groups:
        if c:
            groups[tuple(items)] += c
    least = -(-sum(a * n for a, n in histogram.items()) // limit)
    return [(c, list(items)) for items, c in exchange(groups, limit, least).items()]


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset, how many in each bin), by first rank."""
    out: dict[int, list] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    base = 0
    for count, items in groups:
        at = 0
        for length, each in items:
            out[length].append((rank[length], base, at, each))
            rank[length] += count * each
            at += length * each
        base += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def ranked(table: DataFrame) -> DataFrame:
    """Adds rank: each row's number among the rows of its length, from 0."""
    many = max(1, table.count() // 20_000)
    salted = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(many)))
    counts = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return salted.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own")).drop("own", "before", "bucket")


def pack(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece with its sequence_id and offset."""
    table = stage(pieces(docs, vocabulary, limit), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # limit rows at most
    where = places(layout(histogram, limit))

    def seat(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                rows = np.flatnonzero(length == one)
                p = where[int(one)]
                p = p[np.searchsorted(p[:, 0], rank[rows], side="right") - 1]
                past = rank[rows] - p[:, 0]
                seq[rows], off[rows] = p[:, 1] + past // p[:, 3], p[:, 2] + past % p[:, 3] * one
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    return ranked(table).mapInArrow(seat, f"{PIECES}, sequence_id long, offset long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), default_vocabulary())
