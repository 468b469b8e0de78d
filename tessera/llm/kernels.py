"""Hashes of words and word shingles for whole batches of texts, in numpy.

A word is a run of letters, digits or bytes above 127 of the lower-cased UTF-8 text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE, KEEP = (1 << 20) - (1 << 12), 1 << 19
GOLD, MIX1, MIX2, BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x100000001B3))

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_libc = ctypes.CDLL(None)
#: What an operator keeps in a worker between its tasks, by the operator.
kept: dict[str, dict] = {}
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def salt(k: int) -> np.uint64:
    """The k-th of a row of well spread constants."""
    return np.uint64(k * int(GOLD) & (1 << 64) - 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each at least; up to KEEP of each are kept for the next call."""
    if len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    size = 1 << (n - 1).bit_length()
    made = {}
    for name, base in (("up", BASE), ("down", np.uint64(pow(int(BASE), -1, 1 << 64)))):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made[name] = np.cumprod(steps, dtype=np.uint64)
    if size <= KEEP:
        _powers.update(made)
    return made["up"], made["down"]


def begin(operator: str) -> None:
    """Drops what other operators have kept in this worker, as workers go from one operator's tasks to another's."""
    for name, tables in kept.items():
        if name != operator:
            tables.clear()
    tidy()


def tidy() -> None:
    """Gives memory that this worker holds without need back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: none) and where each begins, with the end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def spans(body: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of `inside` bytes; a run ends with its text."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(body), bool)
    before[0], before[1:] = False, inside[:-1]
    cut = offs[:-1][offs[:-1] < len(body)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(body), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cut[cut > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes."""
    up, down = powers(len(body) + 1)
    sums = np.empty(len(body) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLD)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and of each text the first word's number, with the end."""
    body, offs = flat(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    starts, ends = spans(body, offs, IS_WORD[body])
    return span_hashes(body, starts, ends), np.searchsorted(starts, offs)


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of all texts: hash (48 bits, ascending in a text), times in the text, text's number.

    A text of fewer than `width` words, but one at least, has one shingle of all its words.
    """
    words, first = word_hashes(texts)
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = int(n.sum())
    if not total:
        none = np.zeros(0, np.uint64)
        return none, none.astype(np.int64), none.astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    at = first[:-1][doc] + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    last = first[1:][doc] - 1
    h = np.zeros(total, np.uint64)
    for j in range(width):
        own = np.minimum(at + j, last)
        part = mix(words[own] + salt(j + 1))
        part[at + j > last] = 0
        h = h * BASE + part
    if len(n) > 1 << 16:
        raise ValueError("too many texts at once")
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (mix(h) >> np.uint64(16)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(new, total))
    key = key[new]
    return key & np.uint64((1 << 48) - 1), times, (key >> np.uint64(48)).astype(np.int64)


def text_slices(texts: pa.Array, most: int = SLICE, rows: int = 1 << 14):
    """Ranges of rows with about `most` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    a, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and (total + n > most or i - a >= rows):
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)
