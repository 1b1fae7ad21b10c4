"""Checksums, content hashes, hash buckets and tools for damaged streams, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import codec
from . import tokens as T


def checksum(codes: Column) -> Column:
    """Sum of the codes modulo 32."""
    return F.aggregate(codes, F.lit(0), lambda a, x: F.pmod(a + x, F.lit(32))).cast("int")


def verify_checksum(codes: Column, expected: Column) -> Column:
    """struct(expected, computed, passed)."""
    own = checksum(codes)
    return F.struct(expected.cast("int").alias("expected"), own.alias("computed"), (own == expected).alias("passed"))


def append_checksum(codes: Column) -> Column:
    return F.concat(codes, F.array(F.lit(T.CHECKSUM), checksum(codes)))


def periodic_checksums(records: DataFrame, every: int, order: str = "record_idx", codes: str = "tokens") -> DataFrame:
    """(block, tokens): the records of each ``every`` consecutive ones, once each, with one checksum."""
    block = F.floor(F.col(order) / every).alias("block")
    rows = records.groupBy(block).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(codes).alias("t")))).alias("r"))
    return rows.select("block", append_checksum(F.flatten(F.transform("r", lambda e: e["t"]))).alias("tokens"))


def next_sync_point(codes: Column, start: Column | int = 0) -> Column:
    """Index of the first RECORD or CHECKSUM from ``start``; null if there is none."""
    at = F.transform(codes, lambda t, i: F.when(t.isin(T.RECORD, T.CHECKSUM) & (i >= start), i))
    return F.array_min(at)


def flip_bit(codes: Column, position: Column | int, bit: Column | int) -> Column:
    """The stream with one bit of one token inverted (bit 0 is the first of five)."""
    mask = F.lit(1 << (4 - bit)) if isinstance(bit, int) else F.pow(F.lit(2), 4 - bit).cast("int")
    return F.transform(codes, lambda t, i: F.when(i == position, t.bitwiseXOR(mask)).otherwise(t))


def content_hash(codes: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the packed stream."""
    return F.substring(F.sha2(codec.pack(codes), 256), 1, 16)


def text_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def hash_bucket(key: Column, buckets: int) -> Column:
    """The first eight bytes of the key's SHA-256, as a big-endian number, modulo ``buckets``."""
    number = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(number, F.lit(buckets).cast("decimal(20,0)")).cast("bigint")


def hash_id(text: Column, modulus: int) -> Column:
    """The first four bytes of the SHA-256 of a text, modulo ``modulus``."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint"), F.lit(modulus))
