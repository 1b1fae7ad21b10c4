"""Readers of the packed file formats, through Spark's binaryFile source, and a writer of archives.

Headers are big-endian. A file is one row of the source; its records are split on the executors.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codec
from ..functions.parse import split_records, unpack_bytes
from ..session import ship

# Fixed values of the formats.
ALLOC_MAGIC, DATA_MAGIC, POSITIONED_MAGIC, SINGLE_MAGIC = 0x414C4F43, 0x44415441, 0x47524450, 0x47524442
ARCHIVE = (b"GRDB", 4)  # magic and version
LOG_MAGICS = {b"GDBW": ">III", b"GPWL": ">IIII", b"TXNW": ">IIII", b"WALG": ">IIII"}
ALLOCATED, TOMBSTONE = 1, 2

RECORDS = "path string, record_id bigint, bit_length bigint, flag int, tokens array<int>"
LOG = "path string, seq bigint, txn_id bigint, record_id bigint, flag int, prev_offset bigint, tokens array<int>, sha256 string, intact boolean"


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content) of files."""
    ship(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def _each(df: DataFrame, rows: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(list(rows(path, bytes(content))), columns=names)

    return df.select("path", "content").mapInPandas(run, schema)


def grid(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_idx, bit_offset, tokens) of packed streams behind a four-byte pad count."""

    return grid_rows(files(spark, path))


def _addressed(name: str, table: bytes, data: bytes) -> Iterator[tuple]:
    if struct.unpack(">I", table[:4])[0] != ALLOC_MAGIC:
        raise ValueError(f"{name} is no address table")
    for i in range((len(table) - 8) // 16):
        offset, size, flag = struct.unpack(">QII", table[8 + 16 * i : 24 + 16 * i])
        if flag and offset:
            raw = data[offset : offset + (size + 7) // 8]
            yield name, i, size, flag, unpack_bytes(raw, 8 * len(raw) - size)


def addressed(spark: SparkSession, folder: str) -> DataFrame:
    """Records, tombstones too, of an address table and its data file (alloc.grid and data.grid of one folder)."""
    both = files(spark, folder, "{alloc,data}.grid").withColumn("dir", F.regexp_extract("path", "^(.*)/", 1))
    pairs = both.groupBy("dir").agg(F.max(F.when(F.col("path").endswith("alloc.grid"), F.col("content"))).alias("a"), F.max(F.when(F.col("path").endswith("data.grid"), F.col("content"))).alias("d"))

    def run(batches):
        for pdf in batches:
            for name, a, d in zip(pdf["dir"], pdf["a"], pdf["d"], strict=True):
                yield pd.DataFrame(list(_addressed(name, bytes(a), bytes(d))), columns=["path", "record_id", "bit_length", "flag", "tokens"])

    return pairs.mapInPandas(run, RECORDS)


def positioned(spark: SparkSession, path: str) -> DataFrame:
    """Records of fixed-stride files; empty slots are left out, a deleted one (0 END RECORD) has flag 2."""

    return positioned_rows(files(spark, path).withColumn("first", F.lit(0).cast("bigint")))


def positioned_rows(df: DataFrame) -> DataFrame:
    """The records of (path, first, content) rows that hold fixed-stride files; ``first`` is the id of the first slot."""

    def run(batches):
        for pdf in batches:
            for name, first, content in zip(pdf["path"], pdf["first"], pdf["content"], strict=True):
                yield pd.DataFrame([(p, first + i, *rest) for p, i, *rest in _slots(name, bytes(content))], columns=["path", "record_id", "bit_length", "flag", "tokens"])

    return df.select("path", "first", "content").mapInPandas(run, RECORDS)


def _slots(name: str, content: bytes) -> Iterator[tuple]:
    magic, stride, count = struct.unpack(">III", content[:12])
    if magic != POSITIONED_MAGIC:
        raise ValueError(f"{name} is no fixed-stride file")
    size = stride // 8
    for i in range(count):
        slot = content[12 + i * size : 12 + (i + 1) * size]
        first = next(split_records(unpack_bytes(slot)), None)
        if slot.strip(b"\0") and first:
            yield name, i, 5 * len(first[2]), TOMBSTONE if first[2] == list(DELETED) else ALLOCATED, first[2]


#: What a deleted slot holds.
DELETED = (0, 30, 28)


def write_positioned(records: DataFrame, path: str, stride_bits: int = 1024, slots: int = 4096, codes: str = "tokens") -> None:
    """(record_id, tokens) rows as fixed-stride files of ``slots`` ids each: rows (part, first, content) of a Parquet folder, in id order.

    A stream longer than the stride raises. Of several rows of one id, the one whose ``version`` is the largest counts, if there is
    such a column; deleting is writing a row of ``DELETED`` codes. positioned_rows() reads them back.
    """
    if stride_bits % 8:
        raise ValueError("a stride is whole bytes")
    from ..operators.store import latest, within_stride

    rows = latest(records) if "version" in records.columns else records
    rows = within_stride(rows, codes, stride_bits).select((F.col("record_id") / slots).cast("bigint").alias("part"), F.col("record_id").cast("bigint").alias("id"), codec.pack(F.col(codes)).alias("packed"))
    size = stride_bits // 8

    def assemble(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * slots
        held = bytearray(size * (int(pdf["id"].max()) - first + 1))
        for i, packed in zip(pdf["id"], pdf["packed"], strict=True):
            at = size * (int(i) - first)
            held[at : at + len(packed)] = packed
        head = struct.pack(">III", POSITIONED_MAGIC, stride_bits, len(held) // size)
        return pd.DataFrame({"part": [int(key[0])], "first": [first], "content": [head + bytes(held)]})

    rows.groupBy("part").applyInPandas(assemble, "part bigint, first bigint, content binary").write.parquet(path)


def single(spark: SparkSession, path: str) -> DataFrame:
    """Records, tombstones too, of single-file stores: header, address table, data, and log entries that were not applied, which count last."""

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        magic, version, table, data, _ = struct.unpack(">IIQQQ", content[:32])
        if magic != SINGLE_MAGIC or version != 1:
            raise ValueError(f"{name} is no single-file store")
        held = {}
        for i in range(table // 16):
            offset, size, flag = struct.unpack(">QII", content[64 + 16 * i : 80 + 16 * i])
            if flag and offset:
                raw = content[offset : offset + (size + 7) // 8]
                held[i] = name, i, size, flag, unpack_bytes(raw, 8 * len(raw) - size)
        at = 64 + table + data
        while at + 16 <= len(content) and content[at : at + 4] == b"WALG":
            rid, count, pad = struct.unpack(">iII", content[at + 4 : at + 16])
            raw = content[at + 16 : at + 16 + (5 * count + 7) // 8]
            if len(raw) < (5 * count + 7) // 8:
                break
            held[rid] = name, rid, 5 * count, ALLOCATED, unpack_bytes(raw, pad)
            at += 16 + len(raw)
        yield from (held[i] for i in sorted(held))

    return _each(files(spark, path), rows, RECORDS)


def _entries(name: str, content: bytes) -> Iterator[tuple]:
    """Entries of any of the write-ahead log layouts, up to the first that is cut short."""
    at = 0
    while at + 4 <= len(content):
        magic = content[at : at + 4]
        if magic not in LOG_MAGICS:
            raise ValueError(f"{name}: no entry at byte {at}")
        head = struct.calcsize(LOG_MAGICS[magic])
        fields = struct.unpack(LOG_MAGICS[magic], content[at : at + head]) if at + head <= len(content) else None
        if fields is None:
            return
        seq = txn = rid = flag = prev = None
        count, extra, pad_after = fields[-1], 4, True
        if magic == b"GDBW":
            seq = fields[1]
        elif magic == b"GPWL":
            seq, rid = fields[1], fields[2]
        elif magic == b"TXNW":
            txn, rid = fields[1], fields[2]
        else:
            rid, count, extra, pad_after = fields[1], fields[2], 0, False
        body = at + head + extra
        size = (5 * count + 7) // 8
        end = body + size + 4 * pad_after
        if end + 32 > len(content):
            return
        if extra:
            value = struct.unpack(">i", content[at + head : body])[0]
            flag, prev = (value, None) if magic == b"TXNW" else (None, value)
        digest = content[end : end + 32]
        packed = content[body : body + size]
        own = hashlib.sha256(content[at:end]).digest()
        yield name, seq, txn, rid, flag, prev, unpack_bytes(packed, 8 * size - 5 * count), digest.hex(), own == digest
        at = end + 32


def log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of write-ahead logs, each with whether its content has its hash."""
    return log_rows(files(spark, path))


def log_rows(df: DataFrame) -> DataFrame:
    """The entries in (path, content) rows that hold write-ahead logs."""
    return _each(df, _entries, LOG)


def write_log(entries: DataFrame, path: str, each: int = 10_000) -> None:
    """(seq, record_id, tokens) rows as write-ahead logs of the layout with record ids: rows (part, content) of a Parquet folder, ``each``
    sequence numbers in one. An entry holds the byte offset of the one before it in its log (-1 for the first). log_rows() reads them back."""
    rows = entries.select(F.floor(F.col("seq") / each).alias("part"), "seq", "record_id", F.size("tokens").alias("n"), codec.pack(F.col("tokens")).alias("packed"))

    def assemble(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, last = bytearray(), -1
        for seq, rid, n, packed in pdf.sort_values("seq")[["seq", "record_id", "n", "packed"]].itertuples(index=False):
            body = struct.pack(LOG_MAGICS[b"GPWL"], int.from_bytes(b"GPWL", "big"), int(seq), int(rid), int(n)) + struct.pack(">i", last) + bytes(packed) + struct.pack(">I", -5 * int(n) % 8)
            last = len(out)
            out += body + hashlib.sha256(body).digest()
        return pd.DataFrame({"part": [int(key[0])], "content": [bytes(out)]})

    rows.groupBy("part").applyInPandas(assemble, "part bigint, content binary").write.parquet(path)


def archive(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, content) of the files in archives."""
    return archive_rows(files(spark, path))


def archive_rows(df: DataFrame) -> DataFrame:
    """The files in (path, content) rows that hold archives."""
    from ..functions.parse import parse

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        _, version, count, table_size = struct.unpack(">4sIII", content[:16])
        if version != ARCHIVE[1]:
            raise ValueError(f"{path} is no archive of version {ARCHIVE[1]}")
        rest = content[16:]
        held = {r[1]: parse(r[4]) for r in _addressed(path, rest[:table_size], rest[table_size:])}
        for i in range(0, count, 2):
            if i in held and i + 1 in held:
                name = "".join(t for k, t, _, _ in held[i] if k == "word").replace("-", "_")
                body = bytes(int(v) for k, _, v, _ in held[i + 1] if k == "number")
                yield path, name, len(body), body

    return _each(df, rows, "path string, name string, size bigint, content binary")


def write_archives(content: DataFrame, path: str, each: int = 64) -> None:
    """(idx, name, content) rows as archives of ``each`` consecutive ones: rows (part, content) of a Parquet folder, which archive_rows() reads.

    Names keep lower-case letters, dots and underscores, as the format does: a digit in a name is a number there and gets lost.
    """
    numbered = content.select(F.floor(F.col("idx") / each).alias("part"), (F.col("idx") % each).alias("idx"), "name", "content")
    named = numbered.select("part", F.struct("idx", "name", "content").alias("f")).select("part", "f.*")
    rows = archive_records(named, "part").select("part", "record_id", codec.pack(F.col("tokens")).alias("packed"), (F.size("tokens") * 5).alias("bits"))

    def assemble(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table, data = addressed_bytes([(int(r), bytes(p), int(n)) for r, p, n in zip(pdf["record_id"], pdf["packed"], pdf["bits"], strict=True)])
        head = struct.pack(">4sIII", *ARCHIVE, int(pdf["record_id"].max()) + 1, len(table))
        return pd.DataFrame({"part": [int(key[0])], "content": [head + table + data]})

    rows.groupBy("part").applyInPandas(assemble, "part bigint, content binary").write.parquet(path)


def archive_records(content: DataFrame, *keep: str) -> DataFrame:
    """(record_id, tokens) pairs of an archive of (idx, name, content) rows: a name record and a content record each."""
    size = F.octet_length("content")
    name = F.concat(codec.encode_word(F.lower(F.regexp_replace("name", "_", "-"))), codec.encode_integer(size), F.array(F.lit(28)))
    body = F.concat(codec.encode_bytes(F.col("content")), F.array(F.lit(28)))
    pair = F.explode(F.array(F.struct((F.col("idx") * 2).alias("record_id"), name.alias("tokens")), F.struct((F.col("idx") * 2 + 1).alias("record_id"), body.alias("tokens"))))
    return content.select(*keep, pair.alias("r")).select(*keep, "r.*")


def addressed_bytes(records: list[tuple[int, bytes, int]]) -> tuple[bytes, bytes]:
    """Address table and data file of (record_id, packed, bits) records: an export of bounded size, for tests and exchange."""
    table, data = bytearray(8 + 16 * (max((r[0] for r in records), default=-1) + 1)), bytearray(struct.pack(">IQ", DATA_MAGIC, 0))
    table[:8] = struct.pack(">II", ALLOC_MAGIC, 1)
    for rid, packed, size in records:
        table[8 + 16 * rid : 24 + 16 * rid] = struct.pack(">QII", len(data), size, ALLOCATED)
        data += packed
    data[:12] = struct.pack(">IQ", DATA_MAGIC, len(data))
    return bytes(table), bytes(data)


GRID_TOKENS = 1 << 22


def write_grid(records: DataFrame, path: str, codes: str = "tokens", order: str = "record_idx") -> None:
    """The records in order as packed streams behind a pad count, each of some ``GRID_TOKENS`` codes: rows (part, content) of a Parquet folder.

    grid_rows() reads them back. Parts ascend with the records; a record is in one stream, and no task holds more than one stream.
    """
    ranged = records.repartitionByRange(F.col(order)).sortWithinPartitions(order).select((F.spark_partition_id().cast("bigint") * (1 << 32)).alias("part"), F.col(codes).cast("array<int>").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done, part = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(held)
            bits = (flat[:, None] >> np.array([4, 3, 2, 1, 0])) & 1
            content = struct.pack(">I", -5 * len(flat) % 8) + np.packbits(bits.astype(np.uint8)).tobytes()
            return pa.record_batch([pa.array([part + done], pa.int64()), pa.array([content], pa.binary())], names=["part", "content"])

        for batch in batches:
            lists = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            part = batch.column(0)[0].as_py() if batch.num_rows else part
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + GRID_TOKENS - size, "right")) - 1)
                held.append(flat[ends[at] : ends[stop]])
                size += int(ends[stop] - ends[at])
                at = stop
                if size >= GRID_TOKENS or at < batch.num_rows:
                    yield flush()
                    held, size, done = [], 0, done + 1
        if held:
            yield flush()

    ranged.mapInArrow(run, "part bigint, content binary").write.parquet(path)


def grid_rows(df: DataFrame) -> DataFrame:
    """(path, record_idx, bit_offset, tokens) of (path, content) rows that hold packed streams."""

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        for r in split_records(unpack_bytes(content[4:], struct.unpack(">I", content[:4])[0])):
            yield (name, *r)

    return _each(df, rows, "path string, record_idx bigint, bit_offset bigint, tokens array<int>")
