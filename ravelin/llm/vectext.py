"""Numpy over the UTF-8 buffers of Arrow string arrays: words and their hashes for many texts at once.

Tasks see a bounded number of bytes at a time (``CHUNK`` or one text, whichever is more), never a prefix of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: White space between words: space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside words for matching: everything in ASCII but letters and digits.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of ``h``."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the offsets of each text; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, of ``most`` bytes unless one text is longer."""
    data, off = buffers(texts)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin letters with accents in U+00C0 to U+00DE."""
    low = LOWER[data]
    if len(low) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        low[at] += 32
    return low


def spans(data: np.ndarray, off: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of words: bytes [start, end) of each, and the index of the first word of each text (with one more for the end)."""
    inside = ~outside[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash's base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        inverse = np.uint64(pow(int(_M), -1, 1 << 64))
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_M, inverse)]
    return _powers[0][:n], _powers[1][:n]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges have equal hashes wherever they are."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def rows_of(first: np.ndarray) -> np.ndarray:
    """The text's index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the runs of ``k`` words in each text; a text of 1 to k - 1 words has one run of all its words."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    firsts = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    at = np.repeat(first[:-1] - firsts[:-1], count) + np.arange(firsts[-1])
    end = np.repeat(first[1:], count)
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        here = at + i
        inside = here < end
        out = out * np.uint64(0x2545F4914F6CDD1D) + np.where(inside, h[np.minimum(here, max(len(h) - 1, 0))], np.uint64(0))
    return mix(out), firsts


def sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``x`` over the items of each text."""
    total = np.concatenate([np.zeros((1, *x.shape[1:]), np.float64 if x.dtype.kind == "f" else np.int64), np.cumsum(x, axis=0, dtype=np.float64 if x.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]
