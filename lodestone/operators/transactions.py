"""Transactions over an append-only log of writes.

Every write of a transaction is appended to the log when it is made, as pending. A commit appends one marker; without it
the writes are never seen, which is all that a rollback or a crash needs. Each append is one Parquet commit of a batch.
The state is the latest committed version of each record, so reading it is also the recovery, and it can be repeated.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import store

PENDING, COMMITTED, ROLLED_BACK = 1, 2, 3
LOG = "txn_id bigint, op int, record_id bigint, is_deleted boolean, tokens array<int>, flag int"


class Transaction:
    """Writes that become visible together. A batch of writes holds one row for each record; later batches win."""

    def __init__(self, owner: TransactionalStore, txn_id: int) -> None:
        self.owner, self.txn_id, self.op, self.open = owner, txn_id, 0, True

    def _append(self, rows: DataFrame, flag: int) -> None:
        if not self.open:
            raise RuntimeError("the transaction has ended")
        self.op += 1
        out = rows.select(F.lit(self.txn_id).cast("bigint").alias("txn_id"), F.lit(self.op).alias("op"), F.col("record_id").cast("bigint").alias("record_id"), F.col("is_deleted"), F.col("tokens").cast("array<int>").alias("tokens"), F.lit(flag).alias("flag"))
        out.write.mode("append").parquet(self.owner.log)

    def _mark(self, flag: int) -> None:
        none = self.owner.spark.range(1).select(F.lit(None).cast("bigint").alias("record_id"), F.lit(None).cast("boolean").alias("is_deleted"), F.lit(None).cast("array<int>").alias("tokens"))
        self._append(none, flag)
        self.open, self.owner.active = False, None

    def put(self, writes: DataFrame) -> Transaction:
        """(record_id, tokens) rows."""
        self._append(writes.select("record_id", F.lit(False).alias("is_deleted"), "tokens"), PENDING)
        return self

    def delete(self, ids: DataFrame) -> Transaction:
        """(record_id) rows."""
        self._append(ids.select("record_id", F.lit(True).alias("is_deleted"), F.lit(None).cast("array<int>").alias("tokens")), PENDING)
        return self

    def swap(self, pairs: DataFrame) -> Transaction:
        """(from_id, to_id, from_tokens, to_tokens) rows: both records of each pair are written."""
        sides = F.explode(F.array(*[F.struct(F.col(f"{s}_id").alias("record_id"), F.col(f"{s}_tokens").alias("tokens")) for s in ("from", "to")]))
        return self.put(pairs.select(sides.alias("w")).select("w.*"))

    def commit(self) -> None:
        self._mark(COMMITTED)

    def rollback(self) -> None:
        self._mark(ROLLED_BACK)


class TransactionalStore:
    """Records in a log folder. One transaction is open at a time; writes outside one commit at once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.log = spark, f"{folder}/log"
        self.active: Transaction | None = None
        spark.createDataFrame([], LOG).write.mode("append").parquet(self.log)

    def begin(self) -> Transaction:
        if self.active:
            raise RuntimeError("a transaction is in progress")
        last = self.entries().agg(F.max("txn_id")).first()[0] or 0  # from the files' statistics
        self.active = Transaction(self, max(time.time_ns(), last + 1))
        return self.active

    def entries(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.log)

    def _once(self, name: str, rows: DataFrame) -> None:
        if self.active:
            getattr(self.active, name)(rows)
        else:
            getattr(self.begin(), name)(rows).commit()

    def put(self, writes: DataFrame) -> None:
        self._once("put", writes)

    def delete(self, ids: DataFrame) -> None:
        self._once("delete", ids)

    def records(self) -> DataFrame:
        """Committed writes as versions: by transaction, then by order in it."""
        log = self.entries()
        writes = store.committed(log.where(F.col("flag") == PENDING), log.where(F.col("flag") == COMMITTED))
        return writes.select("record_id", F.struct("txn_id", "op").alias("version"), "is_deleted", "tokens")

    def state(self) -> DataFrame:
        return store.live(self.records())

    def read(self, record_id: int) -> DataFrame:
        return store.read(self.records(), record_id)

    def scan(self, start: int, end: int) -> DataFrame:
        return store.scan(self.records(), start, end)

    def stats(self) -> DataFrame:
        """store.stats() and txn_count, the committed transactions."""
        done: Column = F.lit(self.entries().where(F.col("flag") == COMMITTED).count())
        return store.stats(self.records(), "tokens").withColumn("txn_count", done)
