"""Packs: a corpus as rows of a few MB of compressed documents, for exchanges of numpy blocks.

A pack is what one task read in a row. It serves as the salt of the exchanges: what a pack
sends is aggregated over its documents first, so a key that a third of all documents share
reaches its group once for each pack, and answers go back to packs. Packs are written to
the shared folder, so their composition stays the same when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize
from . import kernel as K

PACK_BYTES = 8 << 20
#: Stands for a null doc_id, which comes after all others.
LAST = 2**63 - 1
PACK_SCHEMA = "pack string, kind int, block binary"


def _to_bytes(rows: pa.Table) -> np.ndarray:
    """Carried columns, if there are any, as an Arrow stream."""
    if not rows.num_columns:
        return np.empty(0, np.uint8)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows.combine_chunks())
    return np.frombuffer(sink.getvalue(), np.uint8)


def carried(block: bytes) -> pa.Table | None:
    """The carried columns of a pack's documents, in their order."""
    raw = K.unpack(block)[4]
    return pa.ipc.open_stream(raw.tobytes()).read_all() if len(raw) else None


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import uuid

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ids = np.concatenate([h[0] for h in held])
        known = np.concatenate([h[1] for h in held])
        lengths = np.concatenate([h[2] for h in held])
        data = np.concatenate([h[3] for h in held])
        rows = pa.Table.from_batches([h[4] for h in held])
        if len(ids) > 1 and not np.all(ids[1:] >= ids[:-1]):
            order, ends = np.argsort(ids, kind="stable"), np.cumsum(lengths)
            data = np.concatenate([data[ends[i] - lengths[i] : ends[i]] for i in order])
            ids, known, lengths, rows = ids[order], known[order], lengths[order], rows.take(pa.array(order))
        row = [uuid.uuid4().hex], [0], [K.pack(ids, known, K.narrow(lengths), data, _to_bytes(rows), level=3)]
        return pa.record_batch([pa.array(row[0], pa.string()), pa.array(row[1], pa.int32()), pa.array(row[2], pa.binary())], names=["pack", "kind", "block"])

    for batch in batches:
        ids = batch.column(0)
        known = np.asarray(ids.is_valid())
        ids = ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = K.utf8(batch.column(1))
        for i, j in K.cuts(offsets, PACK_BYTES // 2):
            held.append((ids[i:j], known[i:j].astype(np.uint8), np.diff(offsets[i : j + 1]), data[offsets[i] : offsets[j]], batch.slice(i, j - i).select(batch.schema.names[2:])))
            size += int(offsets[j] - offsets[i]) + 16 * (j - i)
            if size >= PACK_BYTES:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def documents_in(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id (ascending), whether it is known, bytes and offsets of a pack's documents."""
    ids, known, lengths, data, _ = K.unpack(block)
    return ids, known.astype(bool), data, np.concatenate([[0], np.cumsum(lengths.astype(np.int64))]).astype(np.int64)


def make_packs(docs: DataFrame, *carry: Column) -> DataFrame:
    """(pack, kind = 0, block) rows of a (doc_id, text) DataFrame, written to the shared folder. carry: columns that go along."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    return materialize(plain.mapInArrow(_packed, PACK_SCHEMA))


def bucket_bits(packs: DataFrame, per_bucket: int, each: float) -> int:
    """So many bits of a key that a bucket holds about ``per_bucket`` keys; each: keys for a byte of text."""
    raw = packs.select(F.sum(F.length("block")).alias("n")).first()["n"] or 0
    keys = raw * 2.6 * each
    return int(min(32, max(6, np.ceil(np.log2(max(1.0, keys / per_bucket))))))


def by_pack(packs: DataFrame, answers: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """fn(pack, block, blocks of answers) -> Iterator of record batches, for each pack; answers: (pack, kind = 1, block)."""

    def both(rows: pa.Table) -> pa.Table:
        kinds, blocks, name = rows["kind"].to_pylist(), rows["block"], rows["pack"][0].as_py()
        own = [blocks[i].as_py() for i, k in enumerate(kinds) if k == 0]
        extra = [blocks[i].as_py() for i, k in enumerate(kinds) if k == 1]
        out = [b for block in own for b in fn(name, block, extra)]
        out = pa.Table.from_batches(out) if out else empty
        K.trim()
        return out

    empty = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()
    return packs.unionByName(answers).groupBy("pack").applyInArrow(both, schema)
