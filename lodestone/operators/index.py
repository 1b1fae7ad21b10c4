"""What secondary indexes answer, without index structures: pushed filters and per-key aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_wins(df: DataFrame, key: str, rid: str, seq: str) -> DataFrame:
    """For each key the record first put under it."""
    return df.groupBy(key).agg(F.min_by(rid, seq).alias(rid))


def last_wins(df: DataFrame, key: str, rid: str, seq: str) -> DataFrame:
    """For each key the record last put under it."""
    return df.groupBy(key).agg(F.max_by(rid, seq).alias(rid))


def get(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def range_scan(df: DataFrame, key: str, rid: str, start, end) -> DataFrame:
    """Keys in [start, end) in key order; deleted entries have a negative record id."""
    return df.where((F.col(key) >= start) & (F.col(key) < end) & (F.col(rid) >= 0)).orderBy(key, rid)


def intersect(a: DataFrame, b: DataFrame, rid: str) -> DataFrame:
    """Record ids that two index answers share."""
    return a.select(rid).intersect(b.select(rid))


def infer_fields(df: DataFrame, labels: str) -> list[tuple[str, str]]:
    """(field, type) of a map column: BIGINT if all texts of the field are integers, else STRING."""
    long = df.select(F.explode(labels).alias("name", "value"))
    kinds = long.groupBy("name").agg(F.every(F.col("value").rlike("^-?[0-9]{1,18}$")).alias("number")).orderBy("name")
    return [(r["name"], "BIGINT" if r["number"] else "STRING") for r in kinds.collect()]  # as many rows as fields


def index_labels(df: DataFrame, rid: str, labels: str, path: str) -> None:
    """An index of all fields of a map column, as a folder for each field, its entries sorted by value: what lookup() and between() read.

    A changed record is indexed again by appending its entries with a larger ``version`` column, if the rows have one.
    """
    version = F.col("version") if "version" in df.columns else F.lit(0)
    entries = df.select(F.col(rid).alias("record_id"), version.cast("bigint").alias("version"), F.explode(labels).alias("field", "value"))
    entries = entries.withColumn("number", F.col("value").try_cast("bigint"))
    entries.repartitionByRange("field", "value").sortWithinPartitions("field", "value").write.mode("append").partitionBy("field").parquet(path)


def _entries(spark, path: str, field: str) -> DataFrame:
    """The field's latest entry of each record."""
    own = spark.read.schema("record_id bigint, version bigint, value string, number bigint, field string").parquet(path).where(F.col("field") == field)
    return own.groupBy("record_id").agg(F.max_by(F.struct("value", "number"), "version").alias("e")).select("record_id", "e.*")


def lookup(spark, path: str, field: str, value: str) -> DataFrame:
    """record_id of the records whose field has a value now."""
    return _entries(spark, path, field).where(F.col("value") == value).select("record_id")


def between(spark, path: str, field: str, start: int, end: int) -> DataFrame:
    """record_id and number of the records whose field is a number in [start, end) now, in order."""
    return _entries(spark, path, field).where((F.col("number") >= start) & (F.col("number") < end)).select("record_id", "number").orderBy("number", "record_id")
