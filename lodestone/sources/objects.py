"""An object store as a table: (bucket, path, size, sha256, owner, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SCHEMA = "bucket string, path string, size bigint, sha256 string, owner bigint, content binary"


def objects(files: DataFrame, bucket: str, owner: int) -> DataFrame:
    """Objects of (path, content) rows."""
    content = F.col("content")
    return files.select(F.lit(bucket).alias("bucket"), "path", F.octet_length(content).cast("bigint").alias("size"), F.sha2(content, 256).alias("sha256"), F.lit(owner).cast("bigint").alias("owner"), "content")


def upload(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new objects; an object of the same bucket and path is replaced."""
    return store.join(new.select("bucket", "path"), ["bucket", "path"], "left_anti").select(store.columns).unionByName(new)


def download(store: DataFrame, bucket: str, path: str, user: int | None = None) -> DataFrame:
    found = store.where((F.col("bucket") == bucket) & (F.col("path") == path))
    return found if user is None else found.where((F.col("owner") == user) | F.col("owner").isNull())


def remove(store: DataFrame, bucket: str, path: str) -> DataFrame:
    return store.where(~((F.col("bucket") == bucket) & (F.col("path") == path)))


def listing(store: DataFrame, bucket: str, prefix: str = "", most: int = 100) -> DataFrame:
    """Names and sizes in path order; contents are not read."""
    return store.where((F.col("bucket") == bucket) & F.col("path").startswith(prefix)).select("bucket", "path", "size", "sha256", "owner").orderBy("path").limit(most)
