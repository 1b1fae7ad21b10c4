"""Row policies, owners, grants and tenants as predicates that join the query's plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codec import encode_integer

ADMIN = 1


def owner_only(owner: Column, user: int) -> Column:
    return owner == user


def owner_or_admin(owner: Column, user: int) -> Column:
    return F.lit(True) if user == ADMIN else owner == user


def public_read(owner: Column, user: int) -> Column:
    return F.lit(True)


def authenticated_only(owner: Column, user: int) -> Column:
    return F.lit(user > 0)


class Policies:
    """Predicates by table and action (``read write delete create`` or ``*``). All that apply must hold."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, str, Callable[[Column, int], Column]]] = []

    def add(self, table: str, action: str, rule: Callable[[Column, int], Column]) -> Policies:
        self.rules.append((table, action, rule))
        return self

    def condition(self, table: str, action: str, owner: Column, user: int) -> Column:
        found = [r(owner, user) for t, a, r in self.rules if t in (table, "*") and a in (action, "*")]
        return F.coalesce(reduce(lambda a, b: a & b, found, F.lit(True)), F.lit(False))

    def view(self, df: DataFrame, table: str, action: str, owner: str, user: int, bypass: bool = False) -> DataFrame:
        """Rows the user may see or touch."""
        return df if bypass else df.where(self.condition(table, action, F.col(owner), user))

    def strict(self, df: DataFrame, table: str, action: str, owner: str, user: int) -> DataFrame:
        """The rows; one that the policies forbid is an error."""
        ok = self.condition(table, action, F.col(owner), user)
        return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("not permitted")).cast("boolean")))


    def writes(self, existing: DataFrame, writes: DataFrame, table: str, owner: str, user: int, key: str = "record_id") -> DataFrame:
        """writes with ``action`` (``write`` where ``existing`` has a live row of the key, else ``create``) and ``permitted`` by the existing owner."""
        held = existing.select(key, F.col(owner).alias("_owner"), F.lit(True).alias("_there"))
        both = writes.join(held, key, "left")
        there = F.coalesce(F.col("_there"), F.lit(False))
        by = {a: self.condition(table, a, F.col("_owner"), user) for a in ("write", "create")}
        both = both.withColumns({"action": F.when(there, "write").otherwise("create"), "permitted": F.when(there, by["write"]).otherwise(by["create"])})
        return both.drop("_owner", "_there")


def with_owner(codes: Column, user: int | Column) -> Column:
    """A record's codes behind its owner, who is the value at position 0."""
    return F.concat(encode_integer(user if isinstance(user, Column) else F.lit(user)), codes)


def write_as(existing: DataFrame, writes: DataFrame, user: int, bypass: bool = False, key: str = "record_id", vector: str = "vec", codes: str = "tokens") -> DataFrame:
    """writes (key, tokens) with the user as owner in front, and ``accepted``: the record has no owner yet, or the user is its owner.

    existing: live rows (key, vec), the owner at position 0 of the vector.
    """
    held = existing.select(key, F.get(vector, F.lit(0)).alias("_owner"))
    both = writes.join(held, key, "left").withColumn(codes, with_owner(F.col(codes), user))
    return both.withColumn("accepted", F.lit(bypass) | F.col("_owner").isNull() | (F.col("_owner") == user)).drop("_owner")


def delete_as(existing: DataFrame, ids: DataFrame, user: int, bypass: bool = False, key: str = "record_id", vector: str = "vec") -> DataFrame:
    """ids with ``accepted``, by the rule of write_as(); a record that is not there has nobody to forbid it."""
    held = existing.select(key, F.get(vector, F.lit(0)).alias("_owner"))
    return ids.select(key).join(held, key, "left").select(key, (F.lit(bypass) | F.col("_owner").isNull() | (F.col("_owner") == user)).alias("accepted"))


def owned(df: DataFrame, vector: str, user: int, position: int = 0) -> DataFrame:
    """Rows whose owner, the value at a position of the vector (else the first), is the user; rows without owner are open."""
    owner = F.coalesce(F.get(vector, F.lit(position)), F.get(vector, F.lit(0)))
    return df.where(owner.isNull() | (owner == user))


def readable(records: DataFrame, commands: DataFrame, user: int) -> DataFrame:
    """Records that a user may read by AUTH, GRANT_R and REVOKE commands (record_id, pos, cmd, arg).

    The last AUTH names the owner; of a user's grants and revocations the last counts; a record without owner is open.
    """
    state = commands.groupBy("record_id").agg(
        F.max_by("arg", F.when(F.col("cmd") == "AUTH", F.col("pos"))).alias("owner"),
        F.max_by("cmd", F.when((F.col("arg") == user) & F.col("cmd").isin("GRANT_R", "REVOKE"), F.col("pos"))).alias("grant"),
    )
    state = state.select("record_id", F.when(F.col("owner").isNotNull(), F.col("owner")).alias("owner"), (F.col("grant") == "GRANT_R").alias("granted"))
    both = records.join(state, "record_id", "left")
    return both.where(F.col("owner").isNull() | (F.col("owner") == user) | F.coalesce("granted", F.lit(False))).drop("owner", "granted")


def tenant(df: DataFrame, name: str, column: str = "tenant", most: int | None = None, key: str | None = None) -> DataFrame:
    """One tenant's rows (a partition filter if the table is partitioned by tenant); the first ``most`` by ``key``, else by all columns."""
    rows = df.where(F.col(column) == name)
    return rows if most is None else rows.orderBy(*([key] if key else [c for c in df.columns if c != column])).limit(most)


def without_duplicates(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New rows whose key does not exist yet."""
    return new.join(existing.select(key), key, "left_anti")
