"""Streams run to the end of their input, against the batch result."""

import random
from datetime import datetime, timedelta

from lodestone.session import ship
from lodestone.streaming import feeds
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def run(df, path, mode="append"):
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(f"{path}/o").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/o")


def events(n=400, seed=0):
    rng = random.Random(seed)
    return [(i, T0 + timedelta(seconds=rng.randint(0, 600)), f"u{rng.randint(0, 5)}") for i in range(n)]


def brute_limit(rows, most, seconds):
    held, out = {}, {}
    for i, ts, user in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        mine = [t for t in held.get(user, []) if (ts - t).total_seconds() < seconds]
        out[i] = len(mine) < most
        held[user] = [*mine, ts] if out[i] else mine
    return out


def test_tail_resumes(spark, tmp_path):
    schema = "seq bigint, record_id bigint, flag int"
    spark.createDataFrame([(1, 10, 1), (2, 11, 2)], schema).write.parquet(str(tmp_path / "log"))
    feed = lambda: feeds.subscribe(feeds.typed(feeds.tail(spark, str(tmp_path / "log"), schema)), types=["PUT", "TXN_COMMIT"])
    assert run(feed(), tmp_path).count() == 2
    spark.createDataFrame([(3, 12, 3), (4, 13, 1)], schema).write.mode("append").parquet(str(tmp_path / "log"))
    assert sorted(r["seq"] for r in run(feed(), tmp_path).collect()) == [1, 2, 4]


def test_rate_limit(spark, tmp_path):
    ship(spark)
    rows = events()
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user string")
    want = brute_limit(rows, 3, 60)
    got = {r["event_id"]: r["allowed"] for r in feeds.rate_limit(df, "user", "ts", "event_id", 3, 60.0).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feeds.live_rate_limit(feeds.tail(spark, str(tmp_path / "in"), df.schema), "user", "ts", "event_id", 3, 60.0)
    assert {r["event_id"]: r["allowed"] for r in run(stream, tmp_path).collect()} == want


def test_presence(spark, tmp_path):
    ship(spark)
    beats = [("a", T0), ("a", T0 + timedelta(seconds=20)), ("b", T0), ("c", T0 + timedelta(seconds=55))]
    df = spark.createDataFrame(beats, "user string, ts timestamp")
    now = F.lit(T0 + timedelta(seconds=50))
    assert {r["user"] for r in feeds.presence(df, "user", "ts", now).collect()} == {"a", "c"}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feeds.live_presence(feeds.tail(spark, str(tmp_path / "in"), df.schema), "user", "ts")
    first = run(stream, tmp_path)
    assert {(r["user"], r["event"]) for r in first.collect()} >= {("a", "join"), ("b", "join"), ("c", "join")}
    spark.createDataFrame([("d", T0 + timedelta(seconds=200))], "user string, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    again = run(feeds.live_presence(feeds.tail(spark, str(tmp_path / "in"), df.schema), "user", "ts"), tmp_path)
    assert {r["user"] for r in again.where("event = 'leave'").collect()} >= {"a", "b"}


def test_counts_and_channels(spark):
    rows = events(100)
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user string")
    got = {r["event_id"]: r["n_recent"] for r in feeds.recent_count(df, "user", "ts", 60).collect()}
    for i, ts, user in rows:
        assert got[i] == sum(u == user and 0 <= (ts - t).total_seconds() <= 60 for _, t, u in rows)
    messages = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "channel string, sender int")
    assert feeds.channel(messages, "x", 1).count() == 1


def test_webhooks(spark):
    ship(spark)
    made = spark.createDataFrame([(1, "users", "PUT"), (2, "orders", "PUT"), (3, "users", "DELETE")], "id int, table_name string, type string")
    hooks = spark.createDataFrame([("users", "PUT", "u1"), ("users", "*", "u2")], "hook_table string, hook_type string, url string")
    found = feeds.webhook_matches(made, hooks)
    assert sorted((r["id"], r["url"]) for r in found.collect()) == [(1, "u1"), (1, "u2"), (3, "u2")]
    dead = feeds.deliver(found, lambda row: row["url"] == "u1", lambda seconds: None)
    assert sorted(r["id"] for r in dead.collect()) == [1, 3]


def test_replication_halts(spark):
    log = spark.createDataFrame([(i, f"b{i}") for i in range(10)], "seq bigint, body string")
    signed = log.withColumn("sha256", F.when(F.col("seq") == 6, "bad").otherwise(F.sha2("body", 256)))
    assert [r["seq"] for r in feeds.replicate(signed, F.col("body")).orderBy("seq").collect()] == list(range(6))
    assert feeds.replicate(log.withColumn("sha256", F.sha2("body", 256)), F.col("body")).count() == 10


def test_sessions(spark):
    rows = spark.createDataFrame([(1, T0), (2, T0 + timedelta(hours=25))], "id int, expires timestamp")
    assert [r["id"] for r in feeds.sessions(rows, "expires", F.lit(T0 + timedelta(hours=24))).collect()] == [2]
