"""Equi-joins by three strategies, nearest shards and nearest pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry
from ..session import materialize, size_estimate

#: A side is broadcast only if Spark's own size estimate, from the files, is below this.
BROADCAST_BYTES = 8 << 20


def merge_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, ordered: bool = False) -> DataFrame:
    """Inner join as struct pairs (left, right), by sort-merge; a skewed key is split by adaptive execution. ordered: by key, over all partitions."""
    joined = left.hint("merge").join(right, left[left_key] == right[right_key])
    joined = joined.orderBy(left[left_key]) if ordered else joined
    return joined.select(F.struct(*[left[c] for c in left.columns]).alias("left"), F.struct(*[right[c] for c in right.columns]).alias("right"))


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join that broadcasts ``left`` if its estimated size is small, else leaves the choice to Spark."""
    side = F.broadcast(left) if 0 < size_estimate(left) <= BROADCAST_BYTES else left
    return right.join(side, left[left_key] == right[right_key])


def partitioned_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, partitions: int | None = None) -> DataFrame:
    """Inner join with both sides hashed to the same partitions, by shuffled hash."""
    if partitions:
        left, right = left.repartition(partitions, left_key), right.repartition(partitions, right_key)
    return left.hint("shuffle_hash").join(right, F.col(left_key) == F.col(right_key))


def nearest_shard(rows: DataFrame, address: Column, shards: list[int]) -> DataFrame:
    """rows with ``shard``, the index of the shard address at the smallest Hamming distance; of ties the first.

    The shard list is an argument, not a table, so it becomes literals: no join at all.
    """
    if not shards:
        raise ValueError("no shards")
    options = F.array(*[F.struct(geometry.hamming(address, F.lit(s).cast("bigint")).alias("d"), F.lit(i).alias("i")) for i, s in enumerate(shards)])
    return rows.withColumn("shard", F.array_min(options)["i"])


def nearest_pair(df: DataFrame, key: str, value: str) -> DataFrame:
    """The two rows whose values are closest; ties by the smaller, then the larger key.

    Closest values are neighbours in sorted order. Values are reduced to one row each first (the two
    smallest keys), then each is compared with its predecessor inside ranges, and with the last of the range before.
    """
    least = _two_smallest(df, key, value)
    ranged = materialize(least.repartitionByRange(F.col(value)).withColumn("part", F.spark_partition_id()))  # the ranges must not change between uses
    inside = Window.partitionBy("part").orderBy(value)
    pairs = ranged.select(F.lag("k1").over(inside).alias("ka"), F.lag(value).over(inside).alias("va"), F.col("k1").alias("kb"), F.col(value).alias("vb"))
    edges = ranged.groupBy("part").agg(F.min(F.struct(value, "k1")).alias("lo"), F.max(F.struct(value, "k1")).alias("hi"))
    across = Window.orderBy("part")  # one row for each partition
    seams = edges.select(F.lag("hi").over(across).alias("h"), "lo").select(F.col("h.k1").alias("ka"), F.col(f"h.{value}").alias("va"), F.col("lo.k1").alias("kb"), F.col(f"lo.{value}").alias("vb"))
    same = least.where("k2 is not null").select(F.col("k1").alias("ka"), F.col(value).alias("va"), F.col("k2").alias("kb"), F.col(value).alias("vb"))
    found = pairs.union(seams).union(same).where("ka is not null")
    row = F.struct((F.abs(F.col("vb") - F.col("va"))).alias("distance"), F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return found.agg(F.min(row).alias("m")).select("m.*")


def _two_smallest(df: DataFrame, key: str, value: str) -> DataFrame:
    """For each value its smallest key and the next one, by two map-side-combined minima."""
    first = df.groupBy(value).agg(F.min(key).alias("k1"))
    rest = df.join(first, value).where(F.col(key) > F.col("k1")).groupBy(value).agg(F.min(key).alias("k2"))
    return first.join(rest, value, "left")


def nearest_pair_of_vectors(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The two rows with the smallest Manhattan distance of several integer columns; ties by the smaller, then the larger key.

    Neighbours in sorted order give an upper bound. If it is 0, equal vectors decide. Else rows are dealt
    into cells as wide as the bound, and only rows of the same or of adjacent cells meet; a cell holds few rows,
    because no two are equal and the bound shrinks as rows become denser.
    """
    rows = materialize(df.select(key, *columns).repartitionByRange(*[F.col(c) for c in columns]).withColumn("part", F.spark_partition_id()))
    bound = None
    for window in (Window.partitionBy("part").orderBy(*columns, key), Window.orderBy(*columns, key)):
        if bound is None:  # the second time every partition holds one row at most
            step = sum((F.abs(F.col(c) - F.lag(c).over(window)) for c in columns), F.lit(0))
            bound = rows.select(step.alias("d")).agg(F.min("d").alias("d")).first()["d"]
    found = "distance", "a", "b"
    if bound is None:
        return df.sparkSession.createDataFrame([], "distance bigint, a bigint, b bigint")
    if bound == 0:
        pair = _two_smallest(rows.withColumn("v", F.struct(*columns)), key, "v").where("k2 is not null")
        return pair.agg(F.min(F.struct(F.lit(0).cast("bigint").alias("distance"), F.col("k1").alias("a"), F.col("k2").alias("b"))).alias("m")).select(*[f"m.{c}" for c in found])
    cells = [F.floor(F.col(c) / bound).cast("bigint") for c in columns]
    near = [F.explode(F.array(*[F.lit(s) for s in (-1, 0, 1)])).alias(f"s{i}") for i in range(len(columns))]
    a = rows
    for n in near:
        a = a.select("*", n)
    a = a.select(F.col(key).alias("a"), *[F.col(c).alias(f"a{i}") for i, c in enumerate(columns)], *[(x + F.col(f"s{i}")).alias(f"c{i}") for i, x in enumerate(cells)])
    b = rows.select(F.col(key).alias("b"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(columns)], *[x.alias(f"c{i}") for i, x in enumerate(cells)])
    distance = sum((F.abs(F.col(f"a{i}") - F.col(f"b{i}")) for i in range(len(columns))), F.lit(0)).cast("bigint")
    met = a.join(b, [f"c{i}" for i in range(len(columns))]).where("a < b")
    return met.agg(F.min(F.struct(distance.alias("distance"), "a", "b")).alias("m")).select(*[f"m.{c}" for c in found])
