"""Vectorised text kernels over Arrow buffers, shared by the operators that run in numpy.

Texts stay one UTF-8 byte array with document offsets; no Python string is made per row.
A null text counts as an empty one. Words are ``[^\\x20\\x09-\\x0D]+`` over bytes, which is
the same as over code points because no byte of a multi-byte character is white space.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
_rng = np.random.default_rng(20240601)
#: One random 64-bit value for each byte.
BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 17
_powers: dict[int, np.ndarray] = {}
_libc = None


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table grows as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _BLOCK + 64)
        have = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (int64, first 0) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def cuts(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of at most ``limit`` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    gap = SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = True
    word = ~gap
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _span_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """sum(code(data[s + i]) * BASE**i) modulo 2**64 for each span of bytes; spans ascend, may overlap. A block is widened at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        s0 = int(starts[i])
        j = int(np.searchsorted(ends, s0 + _BLOCK, "right"))
        j = max(j, i + 1)
        e0 = int(ends[j - 1])
        total = np.zeros(e0 - s0 + 1, np.uint64)
        np.cumsum(BYTE_CODE[data[s0:e0]] * powers(_BASE, e0 - s0), out=total[1:])
        a = starts[i:j] - s0
        out[i:j] = (total[ends[i:j] - s0] - total[a]) * powers(_INVERSE, e0 - s0 + 1)[a]
        i = j
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (spans ascend in both ends)."""
    return mix(_span_sums(data, starts, ends) + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every window of ``width`` values, modulo 2**64, mixed; a block that fits the cache at a time."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, block = np.empty(n, np.uint64), 1 << 16
    up, down = powers(_BASE, block + width), powers(_INVERSE, block)
    total = np.zeros(block + width, np.uint64)
    for i in range(0, n, block):
        m = min(block, n - i)
        np.cumsum(values[i : i + m + width - 1] * up[: m + width - 1], out=total[1 : m + width])
        part = total[width : m + width] - total[:m]
        part *= down[:m]
        out[i : i + m] = mix(part)
    return out


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For items numbered through all documents: starts of the windows that lie in one document, and their documents."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    doc = np.repeat(np.arange(len(counts)), counts)
    base = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + base, doc


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n items lie in one of the windows that begin at ``starts`` (distinct, all windows inside)."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def covered_by(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n items lie in one of the ranges [begin, end); begins are distinct, and so are ends."""
    edge = np.zeros(n + 1, np.int8)
    edge[begin] += 1
    edge[end] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        keep = a != b
        if not keep.any():
            break
        u, v, a, b = u[keep], v[keep], a[keep], b[keep]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: workers stay alive between tasks."""
    global _libc
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6")
            _libc.malloc_trim(0)
        except (OSError, AttributeError):
            _libc = False
    elif _libc:
        _libc.malloc_trim(0)


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays (of one dimension) as one compressed block; level 3 pays for texts, not for hashes."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], np.int64)
    return zstandard.ZstdCompressor(level=level).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(block: bytes) -> list[np.ndarray]:
    """What pack() was given."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * count)[1:].reshape(count, 2)
    at, out = 8 * (1 + 2 * count), []
    for code, size in head.tolist():
        kind = np.dtype(chr(code))
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the smallest unsigned type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


class Slots:
    """Numbers of 64-bit keys, by open addressing in numpy arrays."""

    def __init__(self, most: int) -> None:
        self.mask = np.int64((1 << (2 * most).bit_length()) - 1)
        self.keys, self.numbers = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int32)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key (none is 0), or -1."""
        at, out, open_ = self._first(keys), np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(open_):
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.numbers[at[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
            at[open_] = (at[open_] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct new keys."""
        at, open_ = self._first(keys), np.arange(len(keys))
        while len(open_):
            free = self.keys[at[open_]] == 0
            tried = open_[free]
            self.keys[at[tried]] = keys[tried]
            won = self.keys[at[tried]] == keys[tried]
            self.numbers[at[tried[won]]] = numbers[tried[won]]
            open_ = np.concatenate([open_[~free], tried[~won]])
            at[open_] = (at[open_] + 1) & self.mask
