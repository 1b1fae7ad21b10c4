"""Accounts, sessions, key escrow, conditional writes, appends and batch commits."""

from datetime import datetime

import pytest
from lodestone.functions import codec, integrity, parse
from lodestone.operators import accounts, crypto, store
from lodestone.session import ship
from lodestone.sources import binary
from lodestone.streaming import feeds
from pyspark.sql import functions as F

NEW = "email string, password string, name string, salt string"


def test_accounts(spark):
    ship(spark)
    none = spark.createDataFrame([], "user_id bigint, email string, salt string, hash string, name string")
    users = accounts.signup(none, spark.createDataFrame([("a@x", "1", "A", "s"), ("b@x", "2", "B", "t"), ("b@x", "2", "B", "t")], NEW))
    users = accounts.signup(users, spark.createDataFrame([("a@x", "9", "other", "s"), ("c@x", "3", "C", "u")], NEW))
    rows = users.collect()
    assert sorted(r["name"] for r in rows) == ["A", "B", "C"] and sorted(r["user_id"] for r in rows) == [1, 2, 3]
    assert accounts.login(users, "a@x", "1").first()["name"] == "A"
    assert accounts.login(users, "a@x", "9").count() == accounts.login(users, "z@x", "1").count() == 0


def test_sessions(spark):
    now = F.lit(datetime(2024, 1, 1))
    held = spark.range(1).select(accounts.session(F.lit(5), F.lit("token"), now).alias("s")).select("s.*")
    later = F.lit(datetime(2024, 1, 2, 0, 0, 1))
    assert accounts.verify_session(held, "token", now).first()["user_id"] == 5
    assert accounts.verify_session(held, "other", now).count() == accounts.verify_session(held, "token", later).count() == 0


def test_escrow(spark):
    ship(spark)
    key, server = crypto.password_key(b"s", "pw"), b"k" * 32
    rows = spark.createDataFrame([(1, 7, b"one"), (2, 7, b"two"), (3, 8, b"no key")], "record_id bigint, user_id int, content binary")
    sealed = rows.withColumn("content", crypto.encrypt_with_password(F.col("content"), F.col("record_id"), b"s", "pw"))
    escrow = spark.createDataFrame([(7, crypto.escrow_key(key, server))], "user_id int, escrowed binary")
    grants = spark.createDataFrame([(1,), (1,), (3,)], "record_id bigint")
    assert [(r[0], bytes(r[1])) for r in crypto.read_as_server(sealed, grants, escrow, server).collect()] == [(1, b"one")]
    with pytest.raises(Exception, match="wrong key"):
        crypto.read_as_server(sealed, grants, escrow, b"x" * 32).collect()


def test_conditional_writes(spark):
    tokens = codec.encode_record(F.col("record_id"))
    rows = spark.createDataFrame([(1, 1, False), (2, 1, True)], "record_id bigint, version int, is_deleted boolean").withColumn("tokens", tokens)
    own = rows.select("record_id", integrity.content_hash(F.col("tokens")).alias("h")).collect()
    hashes = {r["record_id"]: r["h"] for r in own}
    writes = spark.createDataFrame([(1, hashes[1]), (1, "stale"), (1, None), (2, "stale"), (9, "any")], "record_id bigint, if_match string")
    got = {(r["record_id"], r["if_match"]): r["accepted"] for r in store.update_if_match(rows, writes).collect()}
    assert got == {(1, hashes[1]): True, (1, "stale"): False, (1, None): True, (2, "stale"): True, (9, "any"): True}


def test_json_records(spark):
    ship(spark)
    body = spark.createDataFrame([('{"age": 25.9, "name": "Ann", "x": 1}',), ("{}",)], "b string")
    got = [r[0] for r in body.select(parse.text_of(parse.parsed(store.json_codes(F.col("b"), [("name", "word"), ("age", "int")])))).collect()]
    assert got == ["Ann25", ""]


def test_append(spark, tmp_path):
    store.append(spark.createDataFrame([([1, 30, 28],)], "tokens array<int>"), str(tmp_path / "g"))
    store.append(spark.createDataFrame([([2, 30, 28],)], "tokens array<int>"), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 2
    with pytest.raises(Exception, match="must end"):
        store.append(spark.createDataFrame([([2, 30],)], "tokens array<int>"), str(tmp_path / "g"))


def test_grid_round_trip(spark, tmp_path):
    ship(spark)
    rows = spark.range(500).select(F.col("id").alias("record_idx"), codec.encode_record(F.col("id") * 7).alias("tokens"))
    binary.write_grid(rows, str(tmp_path / "g"))
    back = binary.grid_rows(spark.read.parquet(str(tmp_path / "g")).select(F.col("part").cast("string").alias("path"), "content"))
    assert sorted(parse.parse(r["tokens"])[0][2] for r in back.collect()) == [7 * i for i in range(500)]


def test_batches_are_committed_once(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(5)], "seq bigint").write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        live = feeds.tail(spark, str(tmp_path / "in"), "seq bigint")
        feeds.commit_batches(live, lambda df, n: seen.extend(r["seq"] for r in df.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(seen) == list(range(5))
    past, later = feeds.history_then_live(spark.read.parquet(str(tmp_path / "in")), feeds.tail(spark, str(tmp_path / "in"), "seq bigint"), 2)
    assert [r["seq"] for r in past.collect()] == [3, 4] and later.isStreaming
