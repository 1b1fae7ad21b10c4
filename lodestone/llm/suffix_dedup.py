"""Suffix-array dedup of byte strings, over Burrows-Wheeler transforms of collections of many texts.

1. Anchors. In every 50-byte window the 24-byte gram of the smallest hash is its anchor;
   consecutive windows with one anchor form a segment of at most 76 bytes. Equal windows have equal
   anchors, so a window can repeat only if its anchor does. Packs send their distinct anchors with the numbers of their segments; a
   bucket answers which of them more than one document has, and which are hot.
2. Bins. Segments with such an anchor go to the bin of the anchor, one row for each distinct
   content of a pack with its smallest doc_id. All equal windows of the corpus meet in one bin. Segments of a hot anchor (over
   ``HOT`` of them, as at the edges of a passage that many documents share) go as single windows, dealt by their own hash,
   so that no group grows with the corpus: equal windows are one row for each pack.
3. Construction. A bin cuts its segments into collections by anchor and builds the transform
   and the longest common prefixes of each, one symbol of every segment a round, through sequential files of the shared folder (bwt.py). Rows
   with common prefixes of 50 bytes or more are equal windows; the smallest doc_id of such a run decides.
4. Removal. Packs get back, for each of their segments, the smallest doc_id of its windows,
   mark the windows that a smaller doc_id has, and remove what those cover.

At scale: the rounds of a construction are at most 76, whatever the documents' length, and a
collection has a fixed size, so memory is bounded. A passage that a third of all documents
share is one segment for each pack. False anchor matches (40 bits or more) only cost work; results rest
on the bytes and on 64-bit content hashes of segments.

Defined cases: a null text is empty; a document under 50 bytes keeps all; rows that repeat a doc_id
do not remove one another's bytes; a null doc_id comes after all others; an empty table gives no rows.
kept_text drops the pieces of characters that a removal cut; a long text is a pack of its own, held whole by a task, and its
segments are found in slices of 256 kB. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir
from . import bwt as B
from . import kernel as K
from .packs import bucket_bits, by_pack, carried, documents_in, make_packs
from .substring_dedup import PER_BUCKET, SENT, from_planes, is_in, planes

GRAM = 24
BIN_BYTES, COLLECTION_BYTES, HOT = 3 << 20, 500_000, 1 << 15
SLICE, PLACE_BITS = 1 << 18, 20


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for each i, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def _slices(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, lo, hi): bytes lo..hi of documents i..j; a document longer than a slice is cut, each slice with the windows that begin in it."""
    for i, j in K.cuts(offsets, SLICE):
        lo, end = int(offsets[i]), int(offsets[j])
        while end - lo > SLICE + width - 1:
            yield i, j, lo, lo + SLICE + width - 1
            lo += SLICE
        yield i, j, lo, end


def segments(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor hash and document of every segment."""
    gram = min(GRAM, width)
    out = []
    for i, j, lo, hi in _slices(offsets, width):
        first = np.clip(offsets[i : j + 1], lo, hi) - lo
        part = data[lo:hi]
        if len(part) < width:
            continue
        hashes = K.rolling(K.BYTE_CODE[part], gram)
        bits = np.uint64(PLACE_BITS)  # the same everywhere, so that equal windows have equal anchors: of equal hashes the first one
        tagged = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
        anchor = _window_minima(tagged, width - gram + 1) & np.uint64((1 << int(bits)) - 1)
        inside = np.ones(len(anchor), bool)  # windows that lie in one document
        some = np.diff(first) > 0  # an empty text has no place of its own
        short = np.maximum(first[1:, None][some] - np.arange(1, width), first[:-1, None][some]).reshape(-1)
        inside[short[short < len(inside)]] = False
        new = np.empty(len(anchor), bool)
        new[0], new[1:] = True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        edge = np.flatnonzero(new)
        keep = inside[edge]
        begin, windows = edge[keep], np.diff(np.append(edge, len(anchor)))[keep]
        out.append((begin + lo, windows, hashes[anchor[begin].astype(np.int64)], np.searchsorted(first, begin, "right") - 1 + i))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` + 32 bits."""
    return keys >> np.uint64(32 - bits)


def _arrow(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "bin": pa.int32(), "kind": pa.int32(), "pack": pa.string(), "block": pa.binary()}
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, kinds[n]) for c, n in zip(cols, names, strict=True)], names=names)


def _send_anchors(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                _, _, data, offsets = documents_in(block.as_py())
                _, _, keys, docs = segments(data, offsets, width)
                keys = _short(keys, bits)
                order = np.argsort(keys, kind="stable")
                keys, docs = keys[order], docs[order]
                begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
                end = np.append(begin[1:], len(keys)) - 1 if len(begin) else begin
                # How many segments have the anchor, and 1 less if all are of one document (documents ascend in a run).
                many = np.minimum(2 * (end + 1 - begin) - (docs[begin] == docs[end]), 2 * HOT + 2) if len(begin) else begin
                keys = keys[begin]
                own, at = np.unique(keys >> np.uint64(32), return_index=True)
                rows = [(int(b), name, K.pack(planes(keys[a:z]), K.narrow(many[a:z]))) for b, a, z in zip(own.tolist(), at.tolist(), [*at[1:].tolist(), len(keys)][: len(own)], strict=True)]
                yield _arrow(rows, ["bucket", "pack", "block"])

    return run


def _shared_anchors(rows: pa.Table) -> pa.Table:
    """Of one bucket: to each pack those of its anchors that several documents have, and whether each is hot."""
    names, keys, many, packs = rows["pack"].to_pylist(), [], [], []
    for i, block in enumerate(rows["block"]):
        raw, flags = K.unpack(block.as_py())
        keys.append(from_planes(raw))
        many.append(flags.astype(np.int64))
        packs.append(np.full(len(keys[-1]), i, np.int32))
    keys, many, packs = np.concatenate(keys), np.concatenate(many), np.concatenate(packs)
    order = np.argsort(keys, kind="stable")
    keys, many, packs = keys[order], many[order], packs[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.append(begin, len(keys)))
    several = np.repeat(size > 1, size) | (many % 2 == 0)
    hot = np.repeat(np.add.reduceat((many + 1) // 2, begin) > HOT, size) if len(begin) else several
    keys, packs, hot = keys[several], packs[several], hot[several]
    by = np.argsort(packs, kind="stable")
    keys, hot, edges = keys[by], hot[by], np.searchsorted(packs[by], np.arange(len(names) + 1))
    return pa.Table.from_batches([_arrow([(names[i], 1, K.pack(planes(keys[edges[i] : edges[i + 1]]), np.packbits(hot[edges[i] : edges[i + 1]]))) for i in range(len(names)) if edges[i] < edges[i + 1]], ["pack", "kind", "block"])])


def _gather(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after another."""
    total = int(length.sum())
    return data[np.arange(total) + np.repeat(begin - (np.cumsum(length) - length), length)]


def _content(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    return K.span_hashes(data, begin, begin + windows + width - 1)


def _content_of(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """_content() of spans in any order."""
    order = np.argsort(begin, kind="stable")
    out = np.empty(len(begin), np.uint64)
    out[order] = _content(data, begin[order], windows[order], width)
    return out


def _each_window(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of some segments: the segment, and the place in it."""
    of = np.repeat(np.arange(len(windows)), windows)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)


def _send_segments(width: int, bits: int, bins: int):
    def run(name: str, block: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not answers:
            return
        ids, _, data, offsets = documents_in(block)
        begin, windows, keys, docs = segments(data, offsets, width)
        parts = [(from_planes(raw), flags) for raw, flags in map(K.unpack, answers)]
        flagged, hot = np.concatenate([f for f, _ in parts]), np.concatenate([np.unpackbits(h, count=len(f)).astype(bool) for f, h in parts])
        short = _short(keys, bits)
        hit = is_in(short, np.sort(flagged))
        begin, windows, keys, docs, short = begin[hit], windows[hit], keys[hit], docs[hit], short[hit]
        many = is_in(short, np.sort(flagged[hot]))
        content = _content(data, begin, windows, width)
        order = np.lexsort((docs, content))
        runs = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]]))
        one, last = order[runs], order[np.append(runs[1:], len(order)) - 1]
        begin, windows, keys, many = begin[one], windows[one], keys[one], many[one]
        low, high, anchors = docs[one], docs[last], np.zeros(len(one), np.uint64)  # the smallest and the largest doc_id with the content
        if many.any():  # single windows, each with its own hash for a key, after the segments
            of, step = _each_window(windows[many])
            own = begin[many][of] + step
            content = _content_of(data, own, np.ones(len(own), np.int64), width)
            order = np.argsort(content, kind="stable")
            runs = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]]))
            pick = order[runs]
            low = np.concatenate([low[~many], np.minimum.reduceat(low[many][of][order], runs)])
            high = np.concatenate([high[~many], np.maximum.reduceat(high[many][of][order], runs)])
            anchors = np.concatenate([anchors[~many], keys[many][of][pick]])
            begin, windows, keys = np.concatenate([begin[~many], own[pick]]), np.concatenate([windows[~many], np.ones(len(pick), np.int64)]), np.concatenate([keys[~many], ~content[pick]])
        place = K.mix(keys)
        to, sub = (place % np.uint64(bins)).astype(np.int64), ((place // np.uint64(bins)) & np.uint64(0xFFFFF)).astype(np.int64)
        order = np.lexsort((sub, to))
        begin, windows, low, high, anchors, to, sub = (x[order] for x in (begin, windows, low, high, anchors, to, sub))
        own, edges = np.unique(to, return_index=True)
        rows = []
        for b, at, end in zip(own.tolist(), edges.tolist(), [*edges[1:].tolist(), len(to)][: len(own)], strict=True):
            part = slice(at, end)
            table, slot = np.unique(np.concatenate([ids[low[part]], ids[high[part]]]), return_inverse=True)
            n = end - at
            rows.append((int(b), name, K.pack(K.narrow(np.diff(sub[part], prepend=0)), K.narrow(windows[part]), K.narrow(slot[:n]), K.narrow(slot[n:]), table, _gather(data, begin[part], windows[part] + width - 1), anchors[part], level=3)))
        yield _arrow(rows, ["bin", "pack", "block"])

    return run


def window_minima(data: np.ndarray, begin: np.ndarray, length: np.ndarray, docs: np.ndarray, width: int, place: str) -> np.ndarray:
    """For each window of each text, texts in order: the smallest of ``docs`` over all texts that hold it."""
    transform, prefixes = B.build(data, begin, length, place)
    run = np.cumsum(prefixes < width)
    least = np.full(int(run[-1]) + 1 if len(run) else 1, np.iinfo(np.int64).max)
    rows = [(k, who, run[at]) for k, who, at in B.suffix_rows(transform, length) if k >= width]
    for _, who, at in rows:
        np.minimum.at(least, at, docs[who])
    count = length - width + 1
    base = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for k, who, at in rows:
        out[base[who] + length[who] - k] = least[at]
    return out


def _compare(width: int, place: str):
    def run(rows: pa.Table) -> pa.Table:
        names = rows["pack"].to_pylist()
        subs, windows, low, high, packs, texts, hot = [], [], [], [], [], [], []
        for i, block in enumerate(rows["block"]):
            sub, window, lo, hi, table, data, anchor = K.unpack(block.as_py())
            hot.append(anchor)
            subs.append(np.cumsum(sub, dtype=np.int64))
            windows.append(window.astype(np.int64))
            low.append(table[lo])
            high.append(table[hi])
            packs.append(np.full(len(sub), i, np.int32))
            texts.append(data)
        subs, windows, low, high, packs = (np.concatenate(x) for x in (subs, windows, low, high, packs))
        data, hot = np.concatenate(texts), np.concatenate(hot)
        del texts
        length = windows + width - 1
        begin = np.cumsum(length) - length
        content = _content(data, begin, windows, width)
        order = np.lexsort((content, subs))
        subs, found = subs[order], []
        sizes = np.cumsum(length[order])
        at = 0
        while at < len(order):  # whole sub-bins, together of a fixed size at most, or one larger
            stop = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + COLLECTION_BYTES, "right"))
            last = subs[min(max(stop, at + 1), len(order)) - 1]
            stop = int(np.searchsorted(subs, last, "left" if last > subs[at] and stop < len(order) else "right"))
            take = order[at:stop]
            at = stop
            new = np.concatenate([[True], content[take][1:] != content[take][:-1]])
            which = np.cumsum(new) - 1
            texts = take[new]
            least = np.minimum.reduceat(low[take], np.flatnonzero(new))
            minima = window_minima(data, begin[texts], length[texts], least, width, place)
            count = windows[texts]
            base = np.cumsum(count) - count
            lowest, top = np.minimum.reduceat(minima, base), np.maximum.reduceat(minima, base)
            own = np.flatnonzero(lowest[which] < high[take])  # some window has a smaller doc_id than some document here
            w = which[own]
            values = np.where(lowest[w] == top[w], 1, count[w])
            found.append((packs[take[own]], content[take[own]], values, hot[take[own]], _gather(minima, base[w], values)))
        if not found:
            return pa.Table.from_batches([_arrow([], ["pack", "kind", "block"])])
        to, keys, values, hot, flat = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(to, kind="stable")
        flat = _gather(flat, (np.cumsum(values) - values)[by], values[by])
        to, keys, values, hot = to[by], keys[by], values[by], hot[by]
        edges, ends = np.searchsorted(to, np.arange(len(names) + 1)), np.concatenate([[0], np.cumsum(values)])
        out = []
        for i in np.flatnonzero(np.diff(edges)):
            part = slice(edges[i], edges[i + 1])
            table, slot = np.unique(flat[ends[edges[i]] : ends[edges[i + 1]]], return_inverse=True)
            out.append((names[i], 1, K.pack(keys[part], K.narrow(values[part]), K.narrow(slot), table, np.setdiff1d(hot[part], [0]))))
        K.trim()
        return pa.Table.from_batches([_arrow(out, ["pack", "kind", "block"])])

    return run


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _removed(answers: list[bytes], ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Which bytes of a pack go."""
    if not answers:
        return np.zeros(len(data), bool)
    parts = [K.unpack(a) for a in answers]
    keys = np.concatenate([p[0] for p in parts])
    values = np.concatenate([p[1] for p in parts]).astype(np.int64)
    flat = np.concatenate([p[3][p[2]] for p in parts])
    base = np.cumsum(values) - values
    order = np.argsort(keys)
    keys, values, base = keys[order], values[order], base[order]
    begin, windows, anchors, docs = segments(data, offsets, width)
    alone = is_in(anchors, np.unique(np.concatenate([p[4] for p in parts])))  # hot: their windows were sent one by one
    if alone.any():
        of, step = _each_window(windows[alone])
        begin, docs = np.concatenate([begin[~alone], begin[alone][of] + step]), np.concatenate([docs[~alone], docs[alone][of]])
        windows = np.concatenate([windows[~alone], np.ones(len(of), np.int64)])
    content = _content_of(data, begin, windows, width)
    hit = is_in(content, keys)
    begin, windows, docs = begin[hit], windows[hit], docs[hit]
    which = np.searchsorted(keys, content[hit])
    plain = values[which] == 1
    gone = plain & (flat[base[which]] < ids[docs])
    removed = K.covered_by(len(data), begin[gone], begin[gone] + windows[gone] + width - 1)
    begin, windows, docs, which = begin[~plain], windows[~plain], docs[~plain], which[~plain]
    of, step = _each_window(windows)
    gone = flat[base[which][of] + step] < ids[docs][of]
    removed |= K.covered(len(data), (begin[of] + step)[gone], width)
    return removed


def _remove(width: int, with_text: bool):
    def run(_: str, block: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, known, data, offsets = documents_in(block)
        removed = _removed(answers, ids, data, offsets, width)
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        inside = offsets[:-1][offsets[:-1] < len(data)]
        opens[inside] = removed[inside]
        total, spans = np.concatenate([[0], np.cumsum(removed)])[offsets], np.concatenate([[0], np.cumsum(opens)])[offsets]
        digests, texts = [], []
        for d in range(len(ids)):
            part = data[offsets[d] : offsets[d + 1]]
            kept = (part[~removed[offsets[d] : offsets[d + 1]]] if total[d + 1] > total[d] else part).tobytes()
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode("utf-8", "ignore"))
        columns = [pa.array(ids, pa.int64(), mask=~known), pa.array(np.diff(offsets)), pa.array(np.diff(total)), pa.array(np.diff(spans)), pa.array(digests, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns.append(pa.array(texts, pa.string()))
            names.append("kept_text")
        rows = carried(block)
        if rows is not None:
            columns.append(rows.column(0).combine_chunks())
            names.append("row")
        yield pa.record_batch(columns, names=names)

    return run


def suffix_array_dedup(docs: DataFrame, width: int = 50, with_text: bool = True, carry: Column | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) of each document of (doc_id, text).

    A byte goes if a string of ``width`` bytes that covers it also starts in a document of a
    smaller doc_id. Strings are judged on the input. carry: a column of ``docs`` that comes back
    as ``row``, so that results need not be joined to their rows.
    """
    packs = make_packs(docs, *([] if carry is None else [carry.alias("row")]))
    bits = max(8, bucket_bits(packs, PER_BUCKET, 1 / 14))
    raw = packs.select(F.sum(F.length("block")).alias("n")).first()["n"] or 0
    bins = int(max(16, 2.6 * raw // BIN_BYTES))
    anchors = packs.mapInArrow(_send_anchors(width, bits), SENT)
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors, "pack string, kind int, block binary")
    sent = by_pack(packs, shared, _send_segments(width, bits, bins), "bin int, pack string, block binary")
    answers = sent.groupBy("bin").applyInArrow(_compare(width, shared_dir(docs.sparkSession)), "pack string, kind int, block binary")
    schema = StructType.fromDDL(RESULT + ", kept_text string" * with_text)
    if carry is not None:
        schema = schema.add("row", docs.select(carry.alias("row")).schema["row"].dataType)
    return by_pack(packs, answers, _remove(width, with_text), schema)
