"""Keyed, versioned records over append-only rows.

A record table has ``record_id``, ``version`` (one order for all writers), ``is_deleted`` and value columns.
Writes append; the visible state is the latest version of each key. Plain Parquet has no multi-file commit,
so a store writes each state to a new folder and then replaces one small pointer table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BASE = 10_000_000


def upsert(records: DataFrame, writes: DataFrame) -> DataFrame:
    """Append a version for each written row (columns as in ``records``)."""
    return records.unionByName(writes.withColumn("is_deleted", F.lit(False)) if "is_deleted" not in writes.columns else writes, allowMissingColumns=True)


def delete(records: DataFrame, ids: DataFrame, version: Column | int) -> DataFrame:
    """Append a tombstone for each id that is live. Ids that are not are left alone."""
    gone = live(records).join(ids.select("record_id").distinct(), "record_id", "left_semi")
    gone = gone.withColumns({"is_deleted": F.lit(True), "version": F.lit(version) if isinstance(version, int) else version})
    return records.unionByName(gone)


def latest(records: DataFrame, key: str = "record_id", version: str = "version") -> DataFrame:
    """The latest version of each key, tombstones included: a map-side-combined max_by, so hot keys cost one row a task."""
    rest = [c for c in records.columns if c != key]
    best = records.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r"))
    return best.select(key, "r.*").select(*records.columns)


def live(records: DataFrame, key: str = "record_id", version: str = "version") -> DataFrame:
    return latest(records, key, version).where(~F.col("is_deleted"))


def read(records: DataFrame, record_id) -> DataFrame:
    """The live row of one key; the key reaches the file scan before versions are compared."""
    return live(records.where(F.col("record_id") == record_id))


def scan(records: DataFrame, start: int, end: int, most: int | None = None) -> DataFrame:
    """Live rows with start <= record_id < end, in id order."""
    rows = live(records.where((F.col("record_id") >= start) & (F.col("record_id") < end))).orderBy("record_id")
    return rows if most is None else rows.limit(most)


def occupied(records: DataFrame) -> DataFrame:
    """All ids ever written, tombstones included."""
    return records.select("record_id").distinct()


def stats(records: DataFrame, codes: str | None = None) -> DataFrame:
    """total, allocated, tombstones, data_bits and data_bytes (of live rows), and free: ids below the largest that were never written."""
    bits = F.coalesce(F.sum(F.when(~F.col("is_deleted"), F.size(codes) * 5)), F.lit(0)).cast("bigint") if codes else F.lit(None).cast("bigint")
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_deleted")).alias("allocated"), F.count_if("is_deleted").alias("tombstones"), bits.alias("data_bits")]
    out = latest(records).agg(*counts, (F.coalesce(F.max("record_id") + 1, F.lit(0)) - F.count(F.lit(1))).cast("bigint").alias("free"))
    return out.withColumn("data_bytes", F.ceil(F.col("data_bits") / 8))


class Cached:
    """Live rows held in memory; a write appends its versions and drops what was held, so a read never sees an older state."""

    def __init__(self, records: DataFrame) -> None:
        self.records, self.held = records, None

    def live(self) -> DataFrame:
        if self.held is None:
            self.held = live(self.records).persist()
        return self.held

    def read(self, record_id) -> DataFrame:
        return self.live().where(F.col("record_id") == record_id)

    def write(self, writes: DataFrame) -> None:
        self.invalidate()
        self.records = upsert(self.records, writes)

    def delete(self, ids: DataFrame, version: int) -> None:
        self.invalidate()
        self.records = delete(self.records, ids, version)

    def invalidate(self) -> None:
        if self.held is not None:
            self.held.unpersist()
            self.held = None


def compact(records: DataFrame, path: str) -> DataFrame:
    """Live rows in id order, written to a new folder: the same state gives the same rows in the same order."""
    rows = live(records)
    rows.repartitionByRange(F.col("record_id")).sortWithinPartitions("record_id").write.parquet(path)
    return records.sparkSession.read.parquet(path)


def within_stride(records: DataFrame, codes: str, stride_bits: int = 1024) -> DataFrame:
    """The rows, with an error for a stream longer than the stride."""
    ok = F.when(F.size(codes) * 5 <= stride_bits, F.col(codes)).otherwise(F.raise_error(F.lit("longer than the stride")).cast(records.schema[codes].dataType))
    return records.withColumn(codes, ok)


def compare_and_swap(records: DataFrame, writes: DataFrame, key: str = "record_id", expected: str = "expected_version", order: str = "seq") -> DataFrame:
    """writes with ``accepted``: the expected version is the current one, and no earlier write of the batch took it.

    A missing record is expected as version -1.
    """
    current = latest(records, key).select(key, F.col("version").alias("current"))
    both = writes.join(current, key, "left")
    match = F.col(expected) == F.coalesce(F.col("current"), F.lit(-1))
    first = F.row_number().over(Window.partitionBy(key, match).orderBy(order)) == 1
    return both.withColumn("accepted", match & first).drop("current")


def committed(log: DataFrame, commits: DataFrame, txn: str = "txn_id") -> DataFrame:
    """Log rows whose transaction has a commit marker: the whole of recovery, idempotent."""
    return log.join(commits.select(txn).distinct(), txn, "left_semi")


def resolve_table(tables: DataFrame, name: str = "table_name", order: str = "first_use", local: str = "local_id") -> DataFrame:
    """rows with record_id: BASE for each table in the order of first use, plus the local id. The few names are ranked, not the rows."""
    names = tables.groupBy(name).agg(F.min(order).alias("f"))
    ranked = names.withColumn("ns", F.row_number().over(Window.orderBy("f", name)) - 1).select(name, "ns")
    return tables.join(ranked, name).withColumn("record_id", F.col("ns").cast("bigint") * BASE + F.col(local)).drop("ns")


def chain(log: DataFrame, seq: str, content: Column) -> DataFrame:
    """log with sha256 of each entry's content and prev_hash, that of the entry before."""
    hashed = log.withColumn("sha256", F.sha2(content, 256))
    return with_previous(hashed, seq, "sha256", "prev_hash")


def with_previous(rows: DataFrame, seq: str, value: str, name: str, block: int = 100_000) -> DataFrame:
    """``name``: the value of the row before in seq order, without one task for all rows.

    Rows are numbered in blocks of the sequence; each block takes its predecessor from its own rows, and its
    first row from the last of the blocks before.
    """
    blocked = rows.withColumn("_b", F.floor(F.col(seq) / block))
    inside = Window.partitionBy("_b").orderBy(seq)
    ends = blocked.groupBy("_b").agg(F.max_by(value, seq).alias("_end"))  # one row for each block
    ends = ends.select("_b", F.lag("_end").over(Window.orderBy("_b")).alias("_before"))
    out = blocked.withColumn(name, F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    out = out.join(ends, "_b").withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(name)))
    return out.drop("_b", "_first", "_before")


def verify_chain(log: DataFrame, seq: str, content: Column) -> DataFrame:
    """log with ``intact``: the content has its hash, and prev_hash is that of the entry before."""
    back = with_previous(log, seq, "sha256", "_want")
    return back.withColumn("intact", (F.sha2(content, 256) == F.col("sha256")) & F.col("prev_hash").eqNullSafe(F.col("_want"))).drop("_want")


def before_damage(log: DataFrame, seq: str = "seq", intact: str = "intact") -> DataFrame:
    """Entries before the first damaged one."""
    bad = log.where(~F.col(intact)).agg(F.min(seq).alias("_bad"))
    return log.crossJoin(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col(seq) < F.col("_bad"))).drop("_bad")  # one row against all


def checkpoint(records: DataFrame, seq: str = "version") -> tuple[DataFrame, DataFrame]:
    """The live state, and the largest sequence number it holds (null for an empty log)."""
    return live(records), records.agg(F.max(seq).alias("checkpoint_seq"))


def truncate(log: DataFrame, checkpoint_seq: int | None, seq: str = "seq") -> DataFrame:
    """Entries after a checkpoint."""
    return log if checkpoint_seq is None else log.where(F.col(seq) > checkpoint_seq)


def since(log: DataFrame, after: int, record_id: int | None = None, types: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Entries after a sequence number, of a record and of some types if given, in order."""
    out = log.where(F.col(seq) > after)
    if record_id is not None:
        out = out.where(F.col("record_id") == record_id)
    if types is not None:
        out = out.where(F.col("type").isin(*types))
    return out.orderBy(seq)


def json_codes(body: Column, fields: list[tuple[str, str]]) -> Column:
    """The record of a JSON text: its fields in the order of ``fields`` (name and ``int`` or ``word``); missing ones are skipped, numbers cut to integers."""
    from ..functions import codec

    parts = []
    for name, kind in fields:
        text = F.get_json_object(body, f"$.{name}")
        value = codec.encode_integer(text.cast("double").cast("bigint")) if kind == "int" else codec.encode_word(text)
        parts.append(F.when(text.isNull(), F.array().cast("array<int>")).otherwise(value))
    return F.concat(*parts, F.array(F.lit(28)))


def create_json(records: DataFrame, bodies: DataFrame, fields: list[tuple[str, str]], version: int, body: str = "body") -> DataFrame:
    """records with a new one for each JSON text: its ``_id`` if it has one, else the next free ids, in the order of the texts.

    records: record_id, version, is_deleted, tokens. Texts without ids are numbered by blocks of their hash, so no task orders them all.
    """
    top = records.agg(F.max("record_id")).first()[0]
    own = bodies.select(F.col(body).alias("_body"), F.get_json_object(F.col(body), "$._id").cast("bigint").alias("record_id"))
    given = own.agg(F.max("record_id")).first()[0]
    base = max(-1 if top is None else top, -1 if given is None else given)
    blocks = own.where("record_id is null").withColumn("_b", F.pmod(F.xxhash64("_body"), F.lit(1024)))
    counts = blocks.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # at most 1,024 rows
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_body"))
    free = blocks.join(before, "_b").select("_body", (F.lit(base) + F.col("_before") + place).cast("bigint").alias("record_id"))
    new = own.where("record_id is not null").select("_body", "record_id").union(free)
    rows = new.select("record_id", F.lit(version).cast(records.schema["version"].dataType).alias("version"), F.lit(False).alias("is_deleted"), json_codes(F.col("_body"), fields).alias("tokens"))
    return records.unionByName(rows)


def update_json(records: DataFrame, writes: DataFrame, fields: list[tuple[str, str]], version: int, body: str = "body") -> DataFrame:
    """records with a version for each accepted write (record_id, body, if_match) by update_if_match()."""
    accepted = update_if_match(records, writes).where("accepted")
    rows = accepted.select("record_id", F.lit(version).cast(records.schema["version"].dataType).alias("version"), F.lit(False).alias("is_deleted"), json_codes(F.col(body), fields).alias("tokens"))
    return records.unionByName(rows)


def update_if_match(records: DataFrame, writes: DataFrame, codes: str = "tokens") -> DataFrame:
    """writes (record_id, tokens, if_match) with ``accepted``: no hash is asked for, no record is there, or the current one has that hash."""
    from ..functions.integrity import content_hash

    current = live(records).select("record_id", content_hash(F.col(codes)).alias("_hash"))
    both = writes.join(current, "record_id", "left")
    return both.withColumn("accepted", F.col("if_match").isNull() | F.col("_hash").isNull() | (F.col("if_match") == F.col("_hash"))).drop("_hash")


def append(records: DataFrame, path: str, codes: str = "tokens") -> None:
    """Appends records, each of which must end with RECORD, to a Parquet folder: one commit for the batch."""
    ends = F.element_at(F.col(codes), -1) == 28
    kind = records.schema[codes].dataType
    checked = F.when(F.coalesce(ends, F.lit(False)), F.col(codes)).otherwise(F.raise_error(F.lit("a record must end with RECORD")).cast(kind))
    records.withColumn(codes, checked).write.mode("append").parquet(path)
