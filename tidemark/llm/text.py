"""Words and their hashes for whole batches of texts, as numpy arrays over one byte buffer.

Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased. All work on
wider-than-byte arrays runs over slices of bounded size, so a very long text costs about
three bytes of memory per byte of text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 18
BATCH_BYTES = 4 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed))


_BYTE = seeded(256, 11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP = _powers(_BASE, SLICE * 2)
_DOWN = _powers(_BASE_INVERSE, SLICE * 2)


def join_texts(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a line feed after each, and each text's first byte (one more at the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begins = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=begins[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", dtype=np.uint8), begins


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end byte of every word."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span; spans must be sorted by start and must not nest widely."""
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        upto = int(np.searchsorted(starts, first + SLICE, "left"))
        upto = max(at + 1, upto)
        last = int(ends[at:upto].max())
        if last - first > 2 * SLICE - 1:  # one span longer than a slice: hash it in pieces
            if upto > at + 1:
                upto = at + max(1, int(np.argmax(ends[at:upto] - first > 2 * SLICE - 1)))
                last = int(ends[at:upto].max())
            if last - first > 2 * SLICE - 1:
                out[at] = _long_hash(data[first:last], lower)
                at += 1
                continue
        piece = data[first:last]
        values = _BYTE[_LOWER[piece]] if lower else _BYTE[piece]
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(values * _UP[: len(piece)], out=total[1:])
        s, e = starts[at:upto] - first, ends[at:upto] - first
        out[at:upto] = mix((total[e] - total[s]) * _DOWN[s] + (e - s).astype(np.uint64) * GOLDEN)
        at = upto
    return out


def _long_hash(piece: np.ndarray, lower: bool) -> np.uint64:
    total, factor = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        step = _UP[SLICE - 1] * np.uint64(_BASE)
        for i in range(0, len(piece), SLICE):
            part = piece[i:i + SLICE]
            values = _BYTE[_LOWER[part]] if lower else _BYTE[part]
            total += np.sum(values * _UP[: len(part)], dtype=np.uint64) * factor
            factor *= step
        return mix(np.array([total + np.uint64(len(piece)) * GOLDEN], dtype=np.uint64))[0]


def words_of(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends and, for text i, words offsets[i]:offsets[i + 1]."""
    data, begins = join_texts(texts)
    starts, ends = word_bounds(data)
    return data, starts, ends, np.searchsorted(starts, begins, "left")


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every lower-cased word and the offsets of each text's words."""
    data, starts, ends, offsets = words_of(texts)
    return span_hashes(data, starts, ends), offsets


def window_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `width` words inside each text; a shorter text with words is one window."""
    counts = np.diff(offsets)
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_offsets = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(per, out=out_offsets[1:])
    factors = seeded(width, 5) | np.uint64(1)
    out = np.zeros(int(out_offsets[-1]), dtype=np.uint64)
    if len(words) >= width:
        sums = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for k in range(width):
            sums += words[k:len(words) - width + 1 + k] * factors[k]
        long = counts >= width
        place = np.repeat(offsets[:-1][long], per[long]) + _ranges(per[long])
        out[np.repeat(out_offsets[:-1][long], per[long]) + _ranges(per[long])] = mix(sums[place])
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[offsets[i]:offsets[i + 1]]
        size = np.array([len(own)], dtype=np.uint64)
        out[out_offsets[i]] = mix(np.sum(own * factors[: len(own)], dtype=np.uint64) + size * GOLDEN)[0]
    return out, out_offsets


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def to_ints(column) -> pd.Series:
    """Decimal strings and nulls as nullable 64-bit integers (a column of integers with nulls would turn to floats)."""
    return pd.Series([None if x is None or x != x else int(x) for x in column], dtype="Int64")


def by_size(rows: Iterable[tuple], size_of, limit: int, most: int = 60_000) -> Iterator[list[tuple]]:
    """Group consecutive rows until their sizes reach `limit` or their number `most`."""
    group, total = [], 0
    for row in rows:
        group.append(row)
        total += size_of(row)
        if total >= limit or len(group) >= most:
            yield group
            group, total = [], 0
    if group:
        yield group


@lru_cache(maxsize=1)
def _allocator():
    """The C library where it can be told to give memory back (glibc), set to map arrays above 4 MB on their own."""
    try:
        library = ctypes.CDLL(None)
        library.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        library.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
        library.malloc_trim  # noqa: B018
    except (OSError, AttributeError):
        return None
    return library


def give_back() -> None:
    """Return freed memory to the system: a worker serves one task after another, and what it keeps is missing
    to the executor's heap in later stages."""
    library = _allocator()
    pa.default_memory_pool().release_unused()
    if library is not None:
        library.malloc_trim(0)


def small_batches(frame: DataFrame) -> None:
    """Have the frame's session send rows to Python in batches of about BATCH_BYTES instead of by their number:
    a batch is held several times over, by the executor, by Arrow and as Python strings. A single longer row
    is a batch of its own."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """The batch function `run`, which gives freed memory back at its start and at its end; `forget` drops the
    caches that the worker would otherwise keep for tasks of other stages."""
    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return wrapped


def lean_group(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The group function `run`, which gives freed memory back before and after each group."""
    def wrapped(rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        out = run(rows)
        give_back()
        return out

    return wrapped
