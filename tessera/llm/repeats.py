"""Removal of long repeated byte strings by parsing the corpus into phrases at rolling-hash triggers.

A string of `length` bytes is removed wherever it occurs if it starts at two places or more.

1. Parse: a rolling hash runs over GRAM bytes; in each window of `length` bytes the least hash
   is the trigger, so equal windows have equal triggers at equal places, wherever they lie. Windows
   that share a trigger form one phrase, which reaches from the first such window to the last's end.
2. Dictionary: equal phrases (same trigger, same bytes) are counted over the corpus. A phrase that occurs
   twice repeats as a whole; a phrase whose trigger occurs in no other phrase repeats nowhere.
   In highly repetitive text nearly everything is settled here, at one row per phrase.
3. Only for triggers with several phrases, one of each phrase is split into blocks of STEP windows: blocks whose common
   core occurs once repeat nowhere, blocks with equal covers repeat as a whole, and the windows of the
   others are counted by hash. A window's order among all suffixes isn't needed, only whether another
   has the same first `length` bytes, so equality classes stand in for suffix ranks.

Defined results: a null text is an empty text (nothing removed, the hash of no bytes); texts shorter
than `length` keep all; repeated rows repeat each other; a null doc_id stays null; an empty table gives
an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stage, text_col, unstage
from .kernels import SLICE, flat, mix, powers, salt, text_slices

LENGTH, GRAM, PLACE, STEP = 200, 64, 31, 16
PHRASES = "doc long, th long, j int, ka long, ke long"


class Sums:
    """Prefix sums of a byte string, from which the hash of any part follows."""

    def __init__(self, body: np.ndarray) -> None:
        up, self.down = powers(len(body) + 1)
        self.sums = np.empty(len(body) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((mix(np.arange(256, dtype=np.uint64) + salt(9)))[body] * up[: len(body)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a])


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbouring keys."""
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if width > size else keys


def phrases(body: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """For texts laid end to end: (text, first window, last window, trigger hash, phrase hash, sums, trigger place).

    Places count from the body's start. Texts shorter than `length` have none.
    """
    sizes = np.diff(offs)
    n = np.maximum(0, sizes - length + 1)
    total = int(n.sum())
    none = np.zeros(0, np.int64)
    if not total:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), None, none
    sums = Sums(body)
    at = np.arange(len(body) - gram + 1)
    h = sums.of(at, at + gram)
    where = least((h >> np.uint64(PLACE)) << np.uint64(PLACE) | at.astype(np.uint64), length - gram + 1) & np.uint64((1 << PLACE) - 1)
    doc = np.repeat(np.arange(len(n)), n)
    start = np.repeat(offs[:-1] - (np.cumsum(n) - n), n) + np.arange(total)
    trigger = where[start].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])]))
    first, last = start[new], start[np.append(new[1:], total) - 1]
    place = trigger[new]
    whole = mix(sums.of(first, last + length) + mix((place - first).astype(np.uint64) * salt(3) + (last - first).astype(np.uint64)))
    return doc[new], first, last, h[place], whole, sums, place


def parts(texts: pa.Array):
    """Parses a batch piece by piece: (first row, texts' numbers from there, phrase numbers in the text, places in the text, hashes, sums, trigger places, where the texts begin and end).

    A text longer than a slice is parsed in overlapping pieces; a phrase may then end early, which
    the counts of windows make good. Such texts have no beginning and end here.
    """
    for a, e in text_slices(texts):
        body, offs = flat(texts.slice(a, e - a))
        if e - a > 1 or len(body) <= 2 * SLICE:
            doc, first, last, ka, ke, sums, place = phrases(body, offs)
            lead = np.searchsorted(doc, np.arange(e - a))
            yield a, doc, np.arange(len(doc)) - lead[doc], first, last, offs[:-1][doc], ka, ke, sums, place, offs[:-1][doc], offs[1:][doc]
            continue
        done = 0
        for s in range(0, len(body) - LENGTH + 1, SLICE):
            some = body[s : s + SLICE + LENGTH - 1]
            doc, first, last, ka, ke, sums, place = phrases(some, np.array([0, len(some)]))
            none = np.zeros(len(doc), np.int64)
            yield a, doc, np.arange(len(doc)) + done, first, last, none - s, ka, ke, sums, place, none, none
            done += len(doc)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def parse(docs: DataFrame) -> DataFrame:
    """One row per phrase of each document: whose, its number there, trigger hash, phrase hash."""

    def run(batches):
        for b in batches:
            own, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for a, doc, j, _, _, _, ka, ke, *_ in parts(b.column(2)):
                yield pa.RecordBatch.from_arrays([pa.array(own[a + doc]), pa.array(th[a + doc]), pa.array(j.astype(np.int32)), signed(ka), signed(ke)], names=["doc", "th", "j", "ka", "ke"])

    return docs.select("doc", "th", "text").mapInArrow(run, PHRASES)


def chosen(doc: np.ndarray, j: np.ndarray, lists: dict[int, list]) -> tuple[np.ndarray, np.ndarray]:
    """Weight and block mask of each phrase of a piece; lists: for each text {phrase number, weight, mask}."""
    weight, mask = np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int64)
    for d in np.unique(doc).tolist():
        lo, hi = int(np.searchsorted(doc, d)), int(np.searchsorted(doc, d, side="right"))
        want = lists[d]
        at = np.array([x["j"] for x in want], np.int64) - int(j[lo]) + lo
        fine = (at >= lo) & (at < hi)
        weight[at[fine]] = np.array([x["w"] for x in want], np.int32)[fine]
        np.bitwise_or.at(mask, at[fine], np.array([x["m"] for x in want], np.int64)[fine])
    return weight, mask


def blocks(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted phrase and each STEP neighbouring windows of it: the hashes of what all of them share and of what they cover together.

    Windows that share nothing with another phrase's can't repeat; if all that share a core cover the same, all of them repeat.
    A cover that reaches beyond its text, or lies in a text parsed in pieces, is like no other.
    """
    out = "ka long, core long, cover long, doc long, th long, j int, q int, w int"

    def run(batches):
        for b in batches:
            own, th, js = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_pylist()
            for a, doc, j, first, last, _, ka, _, sums, place, begin, end in parts(b.column(2)):
                if not len(doc):
                    continue
                weight, _ = chosen(doc, j, {int(d): js[a + d] for d in np.unique(doc)})
                use = np.flatnonzero(weight)
                if not len(use):
                    continue
                low, high = (place - last)[use] // STEP, (place - first)[use] // STEP
                n = high - low + 1
                of = np.repeat(use, n)
                q = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                near, far = place[of] - STEP * q, place[of] - STEP * q - STEP + 1
                core = mix(sums.of(near, far + LENGTH) + salt(6) + q.astype(np.uint64))
                whole = (far >= begin[of]) & (near + LENGTH <= end[of])
                rows = a + doc[of]
                cover = mix(th[rows].view(np.uint64) + own[rows].view(np.uint64) * salt(8) + j[of].astype(np.uint64) * salt(9))
                cover[whole] = mix(sums.of(far[whole], near[whole] + LENGTH) + salt(7))
                yield pa.RecordBatch.from_arrays([signed(ka[of]), signed(core), signed(cover), pa.array(own[rows]), pa.array(th[rows]), pa.array(j[of].astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(weight[of])], names=["ka", "core", "cover", "doc", "th", "j", "q", "w"])

    return docs.join(wanted, ["doc", "th"]).select("doc", "th", "text", "js").mapInArrow(run, out)


def windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """ka, wh of every window in the wanted blocks of phrases, with its document, place and weight.

    wanted: doc, th, js: array of (phrase number, weight, mask of blocks).
    """

    def run(batches):
        for b in batches:
            own, th, js = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_pylist()
            for a, doc, j, first, last, base, ka, _, sums, place, *_ in parts(b.column(2)):
                if not len(doc):
                    continue
                weight, mask = chosen(doc, j, {int(d): js[a + d] for d in np.unique(doc)})
                use = np.flatnonzero(weight)
                if not len(use):
                    continue
                n = (last - first + 1)[use]
                of = np.repeat(use, n)
                at = np.repeat(first[use] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                keep = (mask[of] >> ((place[of] - at) // STEP)) & 1 == 1
                of, at = of[keep], at[keep]
                wh = mix(sums.of(at, at + LENGTH) + salt(5))
                rows = a + doc[of]
                yield pa.RecordBatch.from_arrays([signed(ka[of]), signed(wh), pa.array(own[rows]), pa.array(th[rows]), pa.array((at - base[of]).astype(np.int64)), pa.array(weight[of])], names=["ka", "wh", "doc", "th", "at", "w"])

    return docs.join(wanted, ["doc", "th"]).select("doc", "th", "text", "js").mapInArrow(run, "ka long, wh long, doc long, th long, at long, w int")


def strip(docs: DataFrame, whole: DataFrame, loose: DataFrame, closed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; whole: doc, th, js (phrase numbers); loose: doc, th, ats (window places); closed: doc, th, shut (phrase numbers with masks of blocks)."""
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches):
        for b in batches:
            texts, js, ats, shut = b.column(1), b.column(2), b.column(3), b.column(4)
            n = b.num_rows
            marks: dict[int, list] = {}
            need = np.flatnonzero(np.asarray(js.is_valid()) | np.asarray(shut.is_valid()))
            if len(need):
                some = texts.take(pa.array(need))
                for a, doc, j, first, last, base, _, _, _, place, *_ in parts(some):
                    for d in np.unique(doc):
                        lo, hi = np.searchsorted(doc, d), np.searchsorted(doc, d, side="right")
                        row = int(need[a + d])
                        if js[row].is_valid:
                            x = js[row].values.to_numpy() - int(j[lo])
                            x = x[(x >= 0) & (x < hi - lo)] + lo
                            marks.setdefault(row, []).append((first[x] - base[x], last[x] - base[x] + LENGTH))
                        if shut[row].is_valid:
                            _, mask = chosen(doc[lo:hi], j[lo:hi], {int(d): shut[row].as_py()})
                            for x in np.flatnonzero(mask) + lo:
                                q = np.flatnonzero((int(mask[x - lo]) >> np.arange(1 + LENGTH // STEP)) & 1)
                                left = np.maximum(first[x], place[x] - STEP * q - STEP + 1)
                                right = np.minimum(last[x], place[x] - STEP * q)
                                marks.setdefault(row, []).append((left - base[x], right - base[x] + LENGTH))
            rows = []
            for i in range(n):
                body = np.frombuffer(texts[i].as_py().encode(), np.uint8)
                if ats[i].is_valid:
                    x = ats[i].values.to_numpy()
                    marks.setdefault(i, []).append((x, x + LENGTH))
                if i in marks:
                    edge = np.zeros(len(body) + 1, np.int64)
                    for lo, hi in marks[i]:
                        np.add.at(edge, lo, 1)
                        np.add.at(edge, hi, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
                    rows.append((len(body), int(gone.sum()), spans, hashlib.sha256(body[~gone].tobytes()).hexdigest()))
                else:
                    rows.append((len(body), 0, 0, hashlib.sha256(body.tobytes()).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    both = docs.join(whole, ["doc", "th"], "left").join(loose, ["doc", "th"], "left").join(closed, ["doc", "th"], "left")
    return both.select("doc_id", "text", "js", "ats", "shut").mapInArrow(run, out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text"))
    base = base.select(F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text").alias("th"), "doc_id", "text")
    table = stage(parse(base), "phrases")
    triggers = table.groupBy("ka").agg(F.count(F.lit(1)).alias("n"), F.min("ke").alias("lo"), F.max("ke").alias("hi")).filter("n > 1").select("ka", (F.col("lo") != F.col("hi")).alias("mixed"))
    common = stage(table.join(triggers, "ka"), "common")  # what is left of the parse where triggers occur twice
    unstage(table)
    words = stage(common.groupBy("ka", "ke", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "th", "j")).alias("rep")), "dictionary")
    every = F.lit((1 << 62) - 1)
    wanted = words.filter("mixed").groupBy("rep.doc", "rep.th").agg(F.collect_list(F.struct(F.col("rep.j").alias("j"), F.least("n", F.lit(2)).cast("int").alias("w"), every.alias("m"))).alias("js"))
    cut = stage(blocks(base, wanted), "blocks")
    cores = cut.groupBy("ka", "core").agg(F.sum("w").alias("n"), F.min("cover").alias("lo"), F.max("cover").alias("hi")).filter("n > 1").select("ka", "core", (F.col("lo") != F.col("hi")).alias("open"))
    met = stage(cut.join(cores, ["ka", "core"]).select("doc", "th", "j", "q", "w", "open"), "met")
    unstage(cut)
    masks = F.struct("j", "w", F.expr("shiftleft(1L, q)").alias("m"))
    split = stage(windows(base, met.filter("open").groupBy("doc", "th").agg(F.collect_list(masks).alias("js"))), "windows")
    twice = split.groupBy("ka", "wh").agg(F.sum("w").alias("n")).filter("n > 1").select("ka", "wh")
    loose = stage(split.filter("w = 1").join(twice, ["ka", "wh"]).groupBy("doc", "th").agg(F.collect_list("at").alias("ats")), "loose")
    unstage(split)
    closed = met.filter("NOT open AND w = 1").groupBy("doc", "th").agg(F.collect_list(masks).alias("shut"))
    whole = stage(common.join(words.filter("n > 1").select("ka", "ke"), ["ka", "ke"]).groupBy("doc", "th").agg(F.collect_list("j").alias("js")), "whole")
    unstage(common)
    return strip(base, whole, loose, closed)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
