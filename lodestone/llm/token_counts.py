"""Token counts: pieces are counted once for each distinct pre-token, joined to pre-token frequencies, and summed.

1. Frequencies. A task reads whole texts; the documents of some MB become a pack: for each document the numbers of its distinct
   pre-tokens and how often it has each. The pack's distinct pre-tokens go to buckets by their hash. Texts are read once and not moved.
2. Counts. A bucket has each of its pre-tokens once, however many packs sent it, and counts its pieces by the library. Each pack gets
   back the counts of the pre-tokens it sent, in their order: numbers, no words and no ids.
3. Sums. A pack joins the counts to its documents' frequencies and sums.

At scale: what moves is each pack's distinct pre-tokens once, a count for each, and the frequencies. A pre-token of all
documents reaches its bucket once for each pack. Buckets grow in number with the corpus, and beyond ``PACKS`` packs each
is split by pack, so that no group grows: a pre-token is then counted once for so many packs (some 30 GB).

Defined cases: a null or empty text has no tokens; repeated rows are counted each; a null
doc_id stays null; a long text is a pack of its own; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, ship
from . import kernel as K
from . import pretokens
from .packs import PACK_BYTES, by_pack

BUCKET_BYTES, BATCH, PACKS = 16 << 20, 50_000, 4096
SENT = "pack string, kind int, bucket int, block binary"
_models: dict = {}


def count_pieces(model, words: list[str]) -> np.ndarray:
    """The piece counts of some pre-token keys; a text of the library begins with a space mark of its own."""
    out = np.empty(len(words), np.uint32)
    for i in range(0, len(words), BATCH):
        some = words[i : i + BATCH]
        out[i : i + BATCH] = [1 if not key else len(ids) - (key[0] == "\n") for key, ids in zip(some, model.encode(some, num_threads=1), strict=True)]
    return out


def _planes(values: np.ndarray) -> np.ndarray:
    """32-bit numbers byte by byte of their places, so that compression drops the zero bytes."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).reshape(-1)


def _from_planes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


class _Pack:
    """Documents on their way into a pack."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.bytes = buckets, 0
        self.words: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.sizes, self.numbers, self.times = [], [], []

    def add(self, doc_id: int | None, text: str) -> None:
        size = len(text.encode())
        frequency = Counter(pretokens.keys(text.replace("▁", " ")))
        number, place = self.words, np.empty(len(frequency), np.int64)
        for i, word in enumerate(frequency):
            place[i] = number.setdefault(word, len(number))
        order = np.argsort(place)
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.numbers.append(np.diff(place[order], prepend=0))
        self.times.append(np.fromiter(frequency.values(), np.int64, len(frequency))[order])
        self.bytes += size + 16

    def rows(self) -> pa.RecordBatch:
        """The pack (kind 0) and, for each bucket, its words in the order of their numbers (kind 1)."""
        name, words = uuid.uuid4().hex, list(self.words)
        raw = [w.encode() for w in words]
        bucket = np.array([xxhash.xxh64_intdigest(w) % self.buckets for w in raw], np.int64)
        known = np.array([d is not None for d in self.ids], np.uint8)
        ids = np.array([d or 0 for d in self.ids], np.int64)
        none = [np.empty(0, np.int64)]
        lengths = np.array([len(n) for n in self.numbers], np.int64)
        block = K.pack(ids, known, np.array(self.sizes, np.int64), K.narrow(lengths), _planes(np.concatenate(none + self.numbers)), _planes(np.concatenate(none + self.times)), K.narrow(bucket), level=3)
        out = [(name, 0, -1, block)]
        order = np.argsort(bucket, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(order) else order
        for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=False):
            own = [raw[i] for i in order[a:z].tolist()]
            out.append((name, 1, int(bucket[order[a]]), K.pack(np.frombuffer(b"".join(own), np.uint8), K.narrow(np.array([len(w) for w in own])), level=3)))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["pack", "kind", "bucket", "block"])


def _frequencies(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack(buckets)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, _, texts in pretokens.texts(batch, 1):
                for k, text in enumerate(texts):
                    pack.add(ids[i + k], text)
                    if pack.bytes >= PACK_BYTES:
                        yield pack.rows()
                        pack = _Pack(buckets)
        if pack.ids:
            yield pack.rows()

    return run


def _count(path: str):
    def run(rows: pa.Table) -> pa.Table:
        """Of one bucket: to each pack the counts of its words, in their order."""
        if path not in _models:
            _models[path] = pretokens.load(path)
        lists = []
        for block in rows["block"]:
            data, lengths = K.unpack(block.as_py())
            ends, raw = np.cumsum(lengths.astype(np.int64)), data.tobytes()
            lists.append([raw[a:z].decode() for a, z in zip((ends - lengths).tolist(), ends.tolist(), strict=True)])
        words = sorted(set().union(*lists))
        counts = dict(zip(words, count_pieces(_models[path], words).tolist(), strict=True))
        bucket = np.array([rows["bucket"][0].as_py()])
        blocks = [K.pack(bucket, K.narrow(np.array([counts[w] for w in own], np.int64))) for own in lists]
        return pa.table([rows["pack"], pa.array([1] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], names=["pack", "kind", "block"])

    return run


def _sum(limit: int):
    def run(_: str, block: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, known, sizes, lengths, numbers, times, bucket = K.unpack(block)
        counts, got = np.zeros(len(bucket), np.int64), 0
        order = np.argsort(bucket, kind="stable")
        placed = bucket[order]
        for answer in answers:
            own, values = K.unpack(answer)
            lo, hi = np.searchsorted(placed, own[0], "left"), np.searchsorted(placed, own[0], "right")
            counts[order[lo:hi]] = values
            got += len(values)
        if got != len(counts):
            raise ValueError("a bucket's counts are missing")
        ends = np.cumsum(lengths.astype(np.int64))
        steps, begin = _from_planes(numbers), ends - lengths
        run_up = np.cumsum(steps)  # numbers ascend in a document, by their differences
        place = run_up - np.repeat(np.concatenate([[0], run_up])[begin], lengths)
        each = np.concatenate([[0], np.cumsum(counts[place] * _from_planes(times))])
        totals = each[ends] - each[begin]
        yield pa.record_batch([pa.array(ids, pa.int64(), mask=known == 0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(totals > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of (doc_id, text)."""
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(16, (plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    sent = materialize(plain.mapInArrow(_frequencies(buckets), SENT), "kind")
    salts = 1 + sent.where("kind = 0").count() // PACKS
    words = sent.where("kind = 1").select("pack", "bucket", "block", F.pmod(F.xxhash64("pack"), F.lit(salts)).alias("salt"))
    counted = words.groupBy("bucket", "salt").applyInArrow(_count(model_path), "pack string, kind int, block binary")
    return by_pack(sent.where("kind = 0").select("pack", "kind", "block"), counted, _sum(limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
