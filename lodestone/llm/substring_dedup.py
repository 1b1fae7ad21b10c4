"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Every window of ``width`` consecutive words of one document is hashed (a polynomial over
64-bit word hashes, modulo 2**64, by prefix sums). Each pack of documents sorts its hashes,
keeps one entry for each distinct hash with the smallest doc_id that has it, and sends the
entries to buckets by their top bits. A bucket counts a hash over all packs and tells a pack
when a smaller doc_id elsewhere has it. The pack then merges its repeated windows into
maximal intervals and removes them.

At scale: what moves is one entry of 8 to 9 bytes for a distinct window of a pack, whatever the
group sizes, and the texts once, compressed. A hash that a third of all documents share
reaches its bucket once for each pack. Buckets grow in number with the corpus. Two different
windows are confused with a probability of 2**-64.

Defined cases: a null text has no words; a document of fewer words than ``width`` keeps
all; a long text is a pack of its own, held whole by a task; rows that repeat a doc_id do not remove one another's words (windows repeated inside one row are still
removed); a null doc_id comes after all others; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .packs import bucket_bits, by_pack, documents_in, make_packs

PER_BUCKET, SLICE = 400_000, 4 << 20
SENT = "bucket int, pack string, block binary"


def planes(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending values, byte by byte of their places, so that compression drops the zero bytes."""
    steps = np.diff(ascending, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).reshape(-1)


def from_planes(raw: np.ndarray) -> np.ndarray:
    """The inverse of planes()."""
    steps = np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1)
    return np.cumsum(steps, dtype=np.uint64)


def _slices(data: np.ndarray, a: int, end: int) -> Iterator[tuple[int, int]]:
    """Slices of bytes a..end that end before white space."""
    while a < end:
        z = min(a + SLICE, end)
        while z < end and not K.SPACE[data[z]]:
            gap = np.flatnonzero(K.SPACE[data[z : z + SLICE]])
            z = z + int(gap[0]) if len(gap) else min(z + SLICE, end)
        yield a, z
        a = z


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each document, the number of its first one (one more at the end). A long document is met in slices that end before white space."""
    if len(data) <= SLICE:
        starts, ends, first = K.word_spans(data, offsets)
        return K.span_hashes(data, starts, ends), first
    out, counts = [], []
    for d in range(len(offsets) - 1):
        n = 0
        for a, z in _slices(data, int(offsets[d]), int(offsets[d + 1])):
            starts, ends, _ = K.word_spans(data[a:z], np.array([0, z - a]))
            out.append(K.span_hashes(data[a:z], starts, ends))
            n += len(starts)
        counts.append(n)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])


def window_keys(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word of every window, and the first words of the documents."""
    words, first = word_hashes(data, offsets)
    keys = K.rolling(words, width)
    at, doc = K.window_starts(first, width)
    return keys[at], doc, at, first


def _all_keys(data: np.ndarray, offsets: np.ndarray, width: int):
    """window_keys() of a whole pack, worked out over a few MB at a time; first words count through the pack."""
    keys, docs, ats, firsts, words = [], [], [], [np.zeros(1, np.int64)], 0
    for i, j in K.cuts(offsets, 2 << 20):
        k, d, a, f = window_keys(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        keys.append(k)
        docs.append((d + i).astype(np.int32))
        ats.append(a + words)
        firsts.append(f[1:] + words)
        words += int(f[-1])
    none = np.empty(0, np.int64)
    return (np.concatenate(keys or [none.astype(np.uint64)]), np.concatenate(docs or [none]), np.concatenate(ats or [none]), np.concatenate(firsts))


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)


def _send(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                ids, _, data, offsets = documents_in(block.as_py())
                keys, docs, _, _ = _all_keys(data, offsets, width)
                order = np.argsort(keys, kind="stable")  # documents ascend, so the first of a run has the smallest doc_id
                keys = keys[order]
                begin = _groups(keys)
                keys, low = keys[begin], docs[order[begin]]
                own, at = np.unique(keys >> np.uint64(64 - bits), return_index=True)
                rows = []
                for b, a, z in zip(own.tolist(), at.tolist(), [*at[1:].tolist(), len(keys)][: len(own)], strict=True):
                    part = slice(a, z)
                    table, slot = np.unique(ids[low[part]], return_inverse=True)
                    rows.append((int(b), name, K.pack(planes(keys[part]), K.narrow(slot), table)))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], names=["bucket", "pack", "block"])

    return run


def _count(rows: pa.Table) -> pa.Table:
    """Of one bucket: to each pack the hashes that a smaller doc_id of another pack has."""
    names, keys, docs, packs = rows["pack"].to_pylist(), [], [], []
    for i, block in enumerate(rows["block"]):
        raw, slot, table = K.unpack(block.as_py())
        keys.append(from_planes(raw))
        docs.append(table[slot])
        packs.append(np.full(len(slot), i, np.int32))
    keys, docs, packs = np.concatenate(keys), np.concatenate(docs), np.concatenate(packs)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = _groups(keys)
    many = np.diff(np.append(begin, len(keys))) > 1
    within = np.repeat(many, np.diff(np.append(begin, len(keys))))
    order, keys = order[within], keys[within]
    begin = _groups(keys)
    docs, packs = docs[order], packs[order]
    least = np.repeat(np.minimum.reduceat(docs, begin), np.diff(np.append(begin, len(keys)))) if len(begin) else docs
    hit = docs > least
    keys, packs = keys[hit], packs[hit]
    by = np.argsort(packs, kind="stable")
    keys, packs = keys[by], packs[by]
    edges = np.searchsorted(packs, np.arange(len(names) + 1))
    out = [(names[i], 1, K.pack(planes(keys[edges[i] : edges[i + 1]]))) for i in range(len(names)) if edges[i] < edges[i + 1]]
    cols = list(zip(*out, strict=True)) if out else [(), (), ()]
    return pa.table({"pack": pa.array(cols[0], pa.string()), "kind": pa.array(cols[1], pa.int32()), "block": pa.array(cols[2], pa.binary())})


def is_in(keys: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Membership in an ascending array, through a table of bits that most others fail."""
    if not len(ascending):
        return np.zeros(len(keys), bool)
    table = np.zeros(1 << 22, bool)
    table[(ascending & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    out = table[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)]
    near = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(ascending, keys[near]), len(ascending) - 1)
    out[near] = ascending[at] == keys[near]
    return out


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _remove(width: int, with_text: bool):
    def run(_: str, block: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, known, data, offsets = documents_in(block)
        keys, docs, ats, first = _all_keys(data, offsets, width)
        flagged = np.sort(np.concatenate([from_planes(K.unpack(a)[0]) for a in answers])) if answers else np.empty(0, np.uint64)
        gone = is_in(keys, flagged)
        order = np.argsort(keys, kind="stable")
        sorted_keys, row = keys[order], docs[order]
        same = np.concatenate([[False], sorted_keys[1:] == sorted_keys[:-1]]) if len(order) else np.empty(0, bool)
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else np.empty(0, np.int64)
        earlier = ids[row[begin]] < ids[row] if len(order) else same
        again = same & np.concatenate([[False], row[1:] == row[:-1]]) if len(order) else same
        gone[order[earlier | again]] = True
        removed = K.covered(int(first[-1]), ats[gone], width)
        count = np.concatenate([[0], np.cumsum(removed)])[first]
        digests, texts = [], []
        for d in range(len(ids)):
            kept, at = [], int(first[d])
            for a, z in _slices(data, int(offsets[d]), int(offsets[d + 1])):
                words = data[a:z].tobytes().split()
                gone, at = removed[at : at + len(words)], at + len(words)
                words = list(compress(words, (~gone).tolist())) if count[d + 1] > count[d] else words
                if words:
                    kept.append(b" ".join(words))
            kept = b" ".join(kept)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode("utf-8", "replace"))
        columns = [pa.array(ids, pa.int64(), mask=~known), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(count), pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        yield pa.record_batch(columns + [pa.array(texts, pa.string())] * with_text, names=names + ["kept_text"] * with_text)

    return run


def substring_dedup(docs: DataFrame, width: int = 20, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of each document of (doc_id, text).

    A word goes if a window that covers it also starts earlier: in a document of a smaller
    doc_id, or earlier in the same document. Windows are judged on the input.
    """
    packs = make_packs(docs)
    bits = bucket_bits(packs, PER_BUCKET, 1 / 6.5)
    sent = packs.mapInArrow(_send(width, bits), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_count, "pack string, kind int, block binary")
    return by_pack(packs, answers, _remove(width, with_text), RESULT + ", kept_text string" * with_text)
