"""Distances between addresses and value vectors, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def vector(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values]) if values else F.array().cast("array<bigint>")


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two addresses differ."""
    return F.bit_count(a.bitwiseXOR(b))


def manhattan(a: Column, b: Column) -> Column:
    """Sum of the componentwise distances; the shorter vector is padded with zeros."""
    parts = F.zip_with(a, b, lambda x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("bigint"))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + x)


def manhattan_columns(columns: Sequence[str], target: Sequence[int]) -> Column:
    """manhattan() of plain columns to constants, as a sum that code generation fuses."""
    return sum((F.abs(F.col(c) - t) for c, t in zip(columns, target, strict=True)), F.lit(0))


def within(columns: Sequence[str], target: Sequence[int], radius: int) -> Column:
    """Strictly within a radius of the target. Each component's own bound comes first: a range that the file scan can prune by."""
    near = manhattan_columns(columns, target) < radius
    for c, t in zip(columns, target, strict=True):
        near = (F.col(c) > t - radius) & (F.col(c) < t + radius) & near
    return near
