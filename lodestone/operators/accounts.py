"""Accounts and sessions as tables: (user_id, email, salt, hash, name) and (session_hash, user_id, expires_at)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

ROUNDS, DAY = 100_000, 86_400


def password_hash(password: str, salt: str) -> str:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt.encode(), ROUNDS, 32).hex()


@F.pandas_udf(StringType())
def _hashed(password: pd.Series, salt: pd.Series) -> pd.Series:
    return pd.Series([password_hash(p, s) for p, s in zip(password, salt, strict=True)])


def signup(users: DataFrame, new: DataFrame) -> DataFrame:
    """users with the accounts of ``new`` (email, password, name, salt) whose email nobody has; of equal emails one is taken.

    Ids follow the largest one in email order, numbered by ranges: no task orders all new rows.
    """
    fresh = new.dropDuplicates(["email"]).join(users.select("email"), "email", "left_anti")
    top = users.agg(F.coalesce(F.max("user_id"), F.lit(0)).alias("top")).first()["top"]
    blocks = fresh.withColumn("_b", F.pmod(F.xxhash64("email"), F.lit(1024)))
    counts = blocks.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # at most 1,024 rows
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    numbered = blocks.join(before, "_b").withColumn("user_id", F.lit(top) + F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("email")))
    made = numbered.select(F.col("user_id").cast("bigint").alias("user_id"), "email", "salt", _hashed("password", "salt").alias("hash"), "name")
    return users.select("user_id", "email", "salt", "hash", "name").union(made)


def login(users: DataFrame, email: str, password: str) -> DataFrame:
    """The user of an email, if the password is right; the email filter reaches the scan, so one hash is computed."""
    return users.where(F.col("email") == email).where(_hashed(F.lit(password), F.col("salt")) == F.col("hash"))


def session(user_id: Column, token: Column, now: Column) -> Column:
    """A session row for a random token, of which only the hash is kept, for a day."""
    return F.struct(F.sha2(token, 256).alias("session_hash"), user_id.alias("user_id"), (now + F.expr(f"interval {DAY} seconds")).alias("expires_at"))


def verify_session(sessions: DataFrame, token: str, now: Column) -> DataFrame:
    """user_id of a token's session that has not expired."""
    return sessions.where((F.col("session_hash") == hashlib.sha256(token.encode()).hexdigest()) & (F.col("expires_at") > now)).select("user_id")


