"""Vectorised tokenising and hashing of texts in Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACES = (32, 9, 10, 11, 12, 13)
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[list(_SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at a time, unless a single document is longer.
SLICE = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * BASE)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def arrow_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words; words end where their row ends."""
    inside = WORD_BYTE[buf]
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    first = off[:-1][off[:-1] < off[1:]]
    last = off[1:][off[:-1] < off[1:]] - 1
    before[first] = False
    after[last] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span of bytes; spans are disjoint, ascending and not empty."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(at - 0, lens)
    value = BYTE_VALUE[buf[np.repeat(starts, lens) + pos]]
    value *= powers(int(lens.max()))[pos]
    out = np.add.reduceat(value, at)
    return mix(out + lens.astype(U) * U(0xD6E8FEB86659FD93))


def window_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` values: blocks of doubling width are joined by Horner's rule."""
    if len(values) < width:
        return np.zeros(0, U)
    block, size, base = values, 1, int(BASE)
    out, have = None, 0
    while True:
        if width & size:
            if out is None:
                out, have = block, size
            else:
                n = len(values) - have - size + 1
                out = block[:n] * base_of(have) + out[size : size + n]
                have += size
        if size * 2 > width:
            break
        n = len(block) - size
        block = block[:n] * U(base) + block[size : size + n]
        base, size = base * base & 0xFFFFFFFFFFFFFFFF, size * 2
    return mix(out[: len(values) - width + 1])


def base_of(n: int) -> np.uint64:
    return U(pow(int(BASE), n, 1 << 64))


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, in log2(width) vector passes."""
    block, size = key, 1
    while size * 2 <= width:
        block = np.minimum(block[: len(block) - size], block[size:])
        size *= 2
    n = len(key) - width + 1
    return np.minimum(block[:n], block[width - size : width - size + n])


def bytes_hash(buf: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each position."""
    n = len(buf) - 23
    if n <= 0:
        return np.zeros(0, U)
    raw = np.ascontiguousarray(buf)
    at = lambda j: np.ndarray((n,), "<u8", raw.data, j, (1,))
    x = at(0) * U(0x9E3779B185EBCA87)
    x ^= x >> U(32)
    x += at(8)
    x *= U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(29)
    x += at(16)
    return mix(x)


def anchors(grams: np.ndarray, gram: int, width: int, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups the windows of `width` units by their anchor, the least of the hashed grams in them (the first of equal ones).

    grams[i] is the hash of the `gram` units from i; off has where rows begin and end, in units. Returns for each run of
    windows with one anchor: its row, the first window's start, the number of windows and the anchor's hash. Equal windows
    have equal anchors, wherever they are.
    """
    row, start, count, value = [], [], [], []
    step, reach = 1 << 22, width - gram + 1
    valid = np.zeros(max(0, int(off[-1]) - width + 1), bool)
    for a, b in zip(off[:-1], off[1:] - width + 1, strict=True):
        if b > a:
            valid[a:b] = True
    for at in range(0, len(valid), step):
        g = grams[at : min(at + step, len(valid)) + reach - 1]
        key = (g & ~U(0xFFFFFF)) | np.arange(len(g), dtype=U)
        place = (sliding_min(key, reach) & U(0xFFFFFF)).astype(np.int64)
        s = np.flatnonzero(valid[at : at + len(place)])
        if not len(s):
            continue
        p = place[s]
        new = np.ones(len(s), bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
        heads = np.flatnonzero(new)
        count.append(np.diff(np.append(heads, len(s))))
        start.append(s[heads] + at)
        value.append(g[p[heads]])
        row.append(np.searchsorted(off, s[heads] + at, "right") - 1)
    if not row:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    return np.concatenate(row), np.concatenate(start), np.concatenate(count), np.concatenate(value)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n units lie in a span [start, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
