"""Words, shingles and character n-grams of whole Arrow columns as 64-bit numbers, without a Python loop per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 0x9E3779B97F4A7C15
PIECE = 4 << 20
_powers = np.ones(1, dtype=np.uint64)


def normalized(text: Column) -> Column:
    """Lower-cased words (runs of letters and digits) with single blanks between; null stays null."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 256), PRIME, dtype=np.uint64)
            steps[0] = 1
            _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash per word, offsets of each text's words) of texts made by `normalized`.

    For each length in `prefixes`, an array with the hash of each word's first bytes follows, 0 where a word is shorter.
    """
    data, offsets = layout(column)
    is_word = data != 32
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | begins[1:-1]
    starts = np.flatnonzero(first)
    hashes = np.empty(len(starts), dtype=np.uint64)
    heads = [np.zeros(len(starts), dtype=np.uint64) for _ in prefixes]
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(int(np.searchsorted(starts, low + PIECE)), at + 1)
        high = starts[to] if to < len(starts) else len(data)
        own = starts[at:to] - low
        inside = is_word[low:high]
        place = np.arange(high - low) - np.repeat(own, np.diff(np.append(own, high - low)))
        values = (data[low:high].astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place]
        values[~inside] = 0
        hashes[at:to] = np.add.reduceat(values, own)
        sizes = np.add.reduceat(inside.astype(np.int64), own) if prefixes else own
        for head, n in zip(heads, prefixes, strict=True):
            found = np.add.reduceat(np.where(place < n, values, np.uint64(0)), own)
            head[at:to] = np.where(sizes >= n, mix(found + np.uint64(n)), np.uint64(0))
        at = to
    return mix(hashes), np.searchsorted(starts, offsets), *heads


def shingles_of(hashes: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash per run of k words, offsets); a text of 1 to k - 1 words has itself as its only shingle."""
    n = np.diff(offsets)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(n)), counts)
    place = offsets[text] + np.arange(out[-1]) - out[text]
    left = offsets[text + 1] - place
    value = np.zeros(out[-1], dtype=np.uint64)
    for j in range(k):
        word = hashes[np.minimum(place + j, max(len(hashes) - 1, 0))] if len(hashes) else value
        value = value * np.uint64(PRIME) + np.where(j < left, word, np.uint64(0))
    return mix(value), out


def unique_sorted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment, empty ones included."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def letters(text: Column) -> Column:
    """Lower-cased runs of letters between single blanks, with a blank at both ends."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}]+", " ")


def char_grams(column: pa.Array, orders: tuple[int, ...], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot per character n-gram, text per n-gram) of texts made by `letters`; texts hold no line ends."""
    joined = "\n".join(column.fill_null("").to_pylist()) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = points == 10
    text = np.cumsum(ends) - ends
    found, owner = [], []
    value = np.zeros(len(points), dtype=np.uint64)
    broken = np.zeros(len(points), dtype=bool)
    for n in range(1, max(orders) + 1):
        shifted = np.concatenate([points[n - 1 :], np.full(min(n - 1, len(points)), 10, np.uint64)])
        broken = broken | (shifted == 10)
        value = value * np.uint64(PRIME) + shifted
        if n in orders:
            good = ~broken
            found.append((mix(value[good] + np.uint64(n)) % np.uint64(slots)).astype(np.int64))
            owner.append(text[good])
    return np.concatenate(found), np.concatenate(owner)
