"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round keeps components and shortens paths; hot centres are never gathered, because a
minimum per node is a map-side-combined aggregate joined back (a skewed join splits). The
rounds write their links to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import made, materialize, remove


def _round(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the (u, v) links but the roots; the root is the smallest node."""
    spark = links.sparkSession
    links = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40))))
    seen = links.agg(mark.alias("s")).first()["s"]
    while True:
        last = made(spark)[-1]
        links = materialize(_round(links))
        now = links.agg(mark.alias("s")).first()["s"]
        remove(spark, [last])  # what the round before wrote
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
