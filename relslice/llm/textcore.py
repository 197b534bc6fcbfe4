"""Vectorised text kernels: words, n-grams and their 64-bit hashes straight from Arrow string buffers.

All kernels see whole texts. Rows are handled in runs of a few megabytes, so that memory inside a task is
bounded by the run size or by one text, whichever is larger. A null text counts as empty here; callers that
tell the two apart look at the Arrow validity themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240501))
#: Random 64-bit words by position in a word (0 to 63) and byte, for tabulation hashing.
_TABLE = _rng.integers(0, 2**64, 64 * 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes that separate words: space and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A to Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets, without a copy unless there are nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) for consecutive runs of rows of about ``limit`` bytes, one row at least."""
    data, ends = string_buffers(column)
    row, n = 0, ends.size - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1)
        yield row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def words(b: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, text number, 64-bit hash) of each maximal run of ``solid`` bytes within a text."""
    n = b.size
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[bounds < n]
    first[bounds] = solid[bounds]
    starts = np.flatnonzero(first)
    if not starts.size:
        return starts, starts, np.zeros(0, np.uint64)
    at = np.arange(n, dtype=np.int32) - starts.astype(np.int32)[np.cumsum(first, dtype=np.int32) - 1]
    value = _TABLE[((at & 63) << 8) | b]
    if at.max() > 63:
        value *= ((at >> 6).astype(np.uint64) << np.uint64(1)) + np.uint64(1)
    value[~solid] = 0
    h = mix(np.add.reduceat(value, starts))
    return starts, np.searchsorted(offsets, starts, side="right") - 1, h


def space_words(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word between ASCII white space, with A to Z lower-cased."""
    if not b.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    _, text, h = words(LOWER[b], offsets, ~IS_SPACE[b])
    return text, h


def shingles(text: np.ndarray, h: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by text, hashes) of the k-word shingles of each text, repeats included.

    A text with some but fewer than ``k`` words has its whole sequence as its one shingle; one without words
    has none.
    """
    count = np.bincount(text, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(count)])
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    ends = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(ends[-1], np.uint64)
    if h.size >= k:
        g = h[: h.size - k + 1].copy()
        for j in range(1, k):
            g = mix(g * _STEP + h[j : h.size - k + 1 + j])
        whole = text[: h.size - k + 1] == text[k - 1 :]
        owner = text[: h.size - k + 1][whole]
        place = np.flatnonzero(whole) - begin[owner] + ends[owner]
        out[place] = g[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if short.size:
        g = h[begin[short]].copy()
        for j in range(1, k - 1):
            more = count[short] > j
            g[more] = mix(g[more] * _STEP + h[begin[short][more] + j])
        out[ends[short]] = mix(g ^ (count[short].astype(np.uint64) * _M2))
    return ends, out


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values; faster than np.unique on short arrays."""
    if h.size < 2:
        return h.copy()
    s = np.sort(h)
    keep = np.empty(s.size, bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def window_hashes(b: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` consecutive items of ``b`` (bytes, or code points below 2**32)."""
    if b.size < n:
        return np.zeros(0, np.uint64)
    m = b.size - n + 1
    wide = b.astype(np.uint64) + np.uint64(1)
    g = wide[:m] * _STEP
    for j in range(1, n):
        g = (g ^ (g >> np.uint64(29))) * _M1 + wide[j : m + j]
    return mix(g + np.uint64(n * int(_M2) % 2**64))


def code_points(text: str) -> np.ndarray:
    """The code points of a text; lone surrogates are replaced."""
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
