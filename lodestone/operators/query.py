"""Filters, searches, aggregates and ranking over named columns.

All operators build one logical plan: predicates reach the file scan, projections prune columns, and
limits follow an explicit id order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

COMPARE = {"eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
TEXT = {"eq": lambda c, v: F.lower(c) == v.lower(), "contains": lambda c, v: F.contains(F.lower(c), F.lit(v.lower())), "startsWith": lambda c, v: F.startswith(F.lower(c), F.lit(v.lower()))}


def parse_filter(text: str) -> tuple[str, str, str] | None:
    """``field:op:value``, or ``field:value`` for equality; other forms are no filter."""
    parts = text.split(":")
    return tuple(parts) if len(parts) == 3 else (parts[0], "eq", parts[1]) if len(parts) == 2 else None


def predicate(df: DataFrame, field: str, op: str, value: str) -> Column:
    """One comparison, as plain as the file scan can use it. A missing field, an unknown operator or a bad number is false for all rows; null is not true."""
    if field not in df.columns:
        return F.lit(False)
    numeric = isinstance(df.schema[field].dataType, NumericType)
    known = COMPARE if numeric else TEXT
    if op not in known:
        return F.lit(False)
    if numeric:
        try:
            number = float(value)
        except ValueError:
            return F.lit(False)
        return known[op](F.col(field), F.lit(int(number) if number.is_integer() and abs(number) < 2**53 else number))
    return known[op](F.col(field), value)


def where(df: DataFrame, filters: Sequence[str]) -> DataFrame:
    """Rows that pass all filters."""
    parsed = [p for p in map(parse_filter, filters) if p]
    return df.where(reduce(lambda a, b: a & b, (predicate(df, *p) for p in parsed))) if parsed else df


def aggregate(df: DataFrame, filters: Sequence[str] = (), aggregates: Sequence[str] = ()) -> DataFrame:
    """One row: count, and for each ``sum|avg|min|max:field`` a column ``op_field`` (null if no row has a value)."""
    rows = where(df, filters)
    ops = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    out = [F.count(F.lit(1)).alias("count")]
    for item in aggregates:
        op, _, field = item.partition(":")
        if op in ops and field in df.columns:
            out.append(ops[op](field).alias(f"{op}_{field}"))
    return rows.agg(*out)


def search(df: DataFrame, key: str, field: str, value: str, limit: int = 20) -> DataFrame:
    """The first rows, by key, whose number equals ``value``, or, for a text value, any of whose texts holds it."""
    numeric = field in df.columns and isinstance(df.schema[field].dataType, NumericType)
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if numeric:
        hit = F.col(field).cast("string") == value
    else:
        hit = F.contains(F.lower(F.concat_ws("", *texts)), F.lit(value.lower()))
    return df.where(hit).orderBy(key).limit(limit)


def first_rows(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    return df.orderBy(key).limit(n)


def find_first(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """The row of the smallest key that meets a condition."""
    return df.where(condition).orderBy(key).limit(1)


def nearest(df: DataFrame, distance: Column, key: str, k: int | None = None) -> DataFrame:
    """Rows by distance, ties by key; the first k of them."""
    ranked = df.withColumn("distance", distance).orderBy("distance", key)
    return ranked if k is None else ranked.limit(k)


def counts_with_zero(left: DataFrame, right: DataFrame, key: str, right_key: str, amount: str) -> DataFrame:
    """For every row of ``left``: how many rows of ``right`` it has, their total, and whether any. Pre-aggregated before the join."""
    sums = right.groupBy(F.col(right_key).alias(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))
    out = left.select(key).join(sums, key, "left")
    return out.select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("n", F.lit(0)) > 0).alias("has_any"))


def ledger_balance(df: DataFrame, keys: Sequence[str], kind: str, amount: str, plus: str, minus: str) -> DataFrame:
    """Per key the amounts of one kind less those of another."""
    signed = F.when(F.lower(kind) == plus.lower(), F.col(amount)).when(F.lower(kind) == minus.lower(), -F.col(amount))
    return df.groupBy(*keys).agg(F.coalesce(F.sum(signed), F.lit(0)).alias("balance"))


def match_metrics(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in (("tp", truth & guess), ("fp", ~truth & guess), ("fn", truth & ~guess), ("tn", ~truth & ~guess))])
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


class Table:
    """Fluent access to one keyed table: ``Table(df, key).get(5)``, ``.where("a:gt:3").sum("b")``."""

    def __init__(self, df: DataFrame, key: str, filters: tuple[str, ...] = ()) -> None:
        self.df, self.key, self.filters = df, key, filters

    def get(self, key) -> DataFrame:
        return self.df.where(F.col(self.key) == key)

    def where(self, *filters: str) -> Table:
        return Table(self.df, self.key, (*self.filters, *filters))

    def rows(self) -> DataFrame:
        return where(self.df, self.filters)

    def count(self) -> DataFrame:
        return aggregate(self.df, self.filters)

    def _one(self, op: str, field: str) -> DataFrame:
        return aggregate(self.df, self.filters, [f"{op}:{field}"])

    def sum(self, field: str) -> DataFrame:
        return self._one("sum", field)

    def avg(self, field: str) -> DataFrame:
        return self._one("avg", field)

    def min(self, field: str) -> DataFrame:
        return self._one("min", field)

    def max(self, field: str) -> DataFrame:
        return self._one("max", field)

    def _with(self, df: DataFrame) -> Table:
        return Table(df, self.key, self.filters)

    def insert(self, rows: DataFrame) -> Table:
        """The table with new rows; one whose key is there already is left out."""
        return self._with(self.df.unionByName(rows.join(self.df.select(self.key), self.key, "left_anti"), allowMissingColumns=True))

    def update(self, key, if_match: str | None = None, **values) -> Table:
        """The table with other values in the row of a key; with ``if_match``, only if the row still has that hash()."""
        hit = F.col(self.key) == key if if_match is None else (F.col(self.key) == key) & (self.hash() == if_match)
        hit = F.coalesce(hit, F.lit(False))
        return self._with(self.df.select(*[F.when(hit, F.lit(values[c]).cast(self.df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in self.df.columns]))

    def delete(self, key) -> Table:
        return self._with(self.df.where(~F.coalesce(F.col(self.key) == key, F.lit(False))))

    def hash(self) -> Column:
        """First 16 hex digits of the SHA-256 of a row as JSON."""
        return F.substring(F.sha2(F.to_json(F.struct(*self.df.columns)), 256), 1, 16)
