"""Burrows-Wheeler transform and longest common prefixes of a collection, built column by column.

Round k inserts, for every text of the collection at once, the symbol before its suffix of
length k - 1, at the row its new suffix of length k takes. The transform and the common
prefixes so far are read from the files of the last round and written to those of the next, in row order;
only the row numbers of the texts' newest suffixes stay between rounds. Files lie in the folder that driver and executors share.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyarrow import fs


class Column:
    """One value for each row, in a file of the shared folder ``place`` that is written and read in order, whole."""

    def __init__(self, place: str) -> None:
        self.kind, self.file = np.dtype(np.uint8), None
        if place.startswith("/") or place.startswith("file:"):
            self.path = f"{place.removeprefix('file:')}/{uuid.uuid4().hex}"
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.file = open(self.path, "w+b", buffering=0)
        else:
            self.store, root = fs.FileSystem.from_uri(place)
            self.path = f"{root}/{uuid.uuid4().hex}"

    def write(self, values: np.ndarray) -> None:
        self.kind = values.dtype
        if self.file:
            self.file.seek(0)
            view = memoryview(np.ascontiguousarray(values)).cast("B")
            while len(view):
                view = view[self.file.write(view) :]
            self.file.truncate()
            return
        with self.store.open_output_stream(self.path) as out:
            out.write(memoryview(values))

    def read(self) -> np.ndarray:
        if self.file:
            self.file.seek(0)
            return np.frombuffer(self.file.read(), self.kind)
        with self.store.open_input_stream(self.path) as got:
            return np.frombuffer(got.read(), self.kind)

    def close(self) -> None:
        """The file goes. What a lost executor leaves goes with the folder."""
        if self.file:
            self.file.close()
            os.unlink(self.path)
        else:
            self.store.delete_file(self.path)


_twice: dict[type, np.ndarray] = {}


def twice(n: int, kind: type) -> np.ndarray:
    """0, 2, 4, ... (n of them)."""
    if len(_twice.get(kind, ())) < n:
        _twice[kind] = np.arange(0, 2 * max(n, 1 << 18), 2, dtype=kind)
    return _twice[kind][:n]


_LEVELS = 6
_LEVEL = np.minimum(np.frexp(np.arange(1 << (_LEVELS + 1)))[1] - 1, _LEVELS).astype(np.int8)


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first..last]) of each range: by doubling up to 64 values, beyond 128 also over minima of blocks of 64."""
    out = values[last]
    wide = (first != last).nonzero()[0]  # most ranges hold one value
    if not len(wide):
        return out
    first, last = first[wide], last[wide]
    size = last - first + 1
    level = _LEVEL[np.minimum(size, len(_LEVEL) - 1)]
    n, top = len(values), int(level.max())
    table = np.empty((top + 1, n), values.dtype)
    table[0] = values
    for k in range(1, top + 1):
        half = 1 << (k - 1)
        np.minimum(table[k - 1, : n - 2 * half + 1], table[k - 1, half : n - half + 1], out=table[k, : n - 2 * half + 1])
    flat, base = table.reshape(-1), level.astype(np.int64) * n
    found = np.minimum(flat[base + first], flat[base + last + 1 - (1 << level.astype(np.int64))])
    far = (size > 2 << _LEVELS).nonzero()[0]
    if len(far):
        block = 1 << _LEVELS
        begin, end = -(-first[far] // block), (last[far] + 1) // block - 1  # whole blocks inside
        found[far] = np.minimum(found[far], _range_minima(np.ascontiguousarray(table[_LEVELS, : n - block + 1 : block]), begin, end))
    out[wide] = found
    return out


def build(data: np.ndarray, begin: np.ndarray, length: np.ndarray, place: str) -> tuple[np.ndarray, np.ndarray]:
    """(bwt, lcp) of the collection data[begin[i] : begin[i] + length[i]], each text with its own end mark, by files in the folder ``place``.

    End marks sort before all symbols, in text order. Rows 0..n-1 are the end marks alone.
    In ``bwt`` the value 255 (65535 if the data hold 255) stands before whole texts.
    lcp[r] counts the symbols that rows r - 1 and r share, at most 255 texts symbols long.
    """
    n = len(begin)
    wide = len(data) and data.max() == 255
    kind, stop = (np.uint16, 65535) if wide else (np.uint8, 255)
    prefixes = np.uint8 if n == 0 or length.max() < 255 else np.uint32
    end = begin + length
    bwt_file, lcp_file = Column(place), Column(place)
    narrow = kind is np.uint8 and int(np.sum(length)) + n < 1 << 23
    kinds, shift = (np.uint32, np.uint32(24)) if narrow else (np.uint64, np.uint64(48))

    def row_of(key: np.ndarray) -> np.ndarray:
        return ((key & ((kinds(1) << shift) - kinds(1))) >> kinds(1)).astype(np.int64)

    def before(who: np.ndarray, k: int) -> np.ndarray:
        """The symbol before the suffix of length k."""
        return np.where(length[who] > k, data[end[who] - k - 1].astype(kind), kind(stop))

    alive = np.arange(n)
    bwt_file.write(before(alive, 0))
    lcp_file.write(np.zeros(n, prefixes))
    rows = np.arange(n)
    k = 0
    while True:
        k += 1
        more = length[alive] >= k
        alive, rows = alive[more], rows[more]
        if not len(alive):
            done = bwt_file.read(), lcp_file.read()
            bwt_file.close()
            lcp_file.close()
            return done
        bwt, lcp = bwt_file.read(), lcp_file.read()
        size = len(bwt)
        # Row n + r of the new column begins with the r-th symbol of bwt in stable order: sort (symbol, row, whether new).
        key = bwt.astype(kinds)
        key <<= shift
        key |= twice(size, kinds)
        key[rows] |= kinds(1)
        key.sort()
        new = ((key & kinds(1)) != 0).nonzero()[0]
        text_at = np.empty(size, np.int32)
        text_at[rows] = alive
        alive, rows = text_at[row_of(key[new])], new + n  # from here in row order
        old = np.ones(size + len(new), bool)
        old[rows] = False
        grown = np.empty(len(old), kind)
        grown[old] = bwt
        grown[rows] = before(alive, k)
        prefix = np.empty(len(old), prefixes)
        prefix[old] = lcp
        after = new + 1
        at = np.concatenate([new, after[np.append(after[:-1] != new[1:], after[-1] < len(old) - n)]])  # new rows, and old rows after them
        here, last = key[at], key[np.maximum(at - 1, 0)]
        shared = ((at > 0) & ((here >> shift) == (last >> shift))).nonzero()[0]
        value = np.zeros(len(at), prefixes)
        value[shared] = _range_minima(lcp, row_of(last[shared]) + 1, row_of(here[shared])) + prefixes(1)
        prefix[at + n] = value
        bwt_file.write(grown)
        lcp_file.write(prefix)


def suffix_rows(bwt: np.ndarray, length: np.ndarray):
    """For k = 1, 2, ...: (texts of at least k symbols, rows of their suffixes of length k), by walking the transform."""
    n = len(length)
    rank = np.empty(len(bwt), np.int32)
    rank[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
    alive, rows, k = np.arange(n), np.arange(n), 0
    while True:
        k += 1
        more = length[alive] >= k
        alive, rows = alive[more], rows[more]
        if not len(alive):
            return
        rows = n + rank[rows]
        yield k, alive, rows
