"""Store, joins, policies, encryption and file formats."""

import hashlib
import struct

import pytest
from lodestone.functions import codec, parse
from lodestone.operators import crypto, index, joins, policy, query, store
from lodestone.session import ship
from lodestone.sources import binary, objects
from pyspark.sql import functions as F

SCHEMA = "record_id bigint, version bigint, is_deleted boolean, name string, usd bigint"


@pytest.fixture
def records(spark):
    rows = [(0, 1, False, "Alice", 5000), (1, 2, False, "Bob", 10000), (1_000_000, 3, False, "Charlie-sparse", 7500), (42, 4, False, "Douglas", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [r["record_id"] for r in df.collect()]


def test_write_read_delete_scan(spark, records):
    gone = store.delete(records, spark.createDataFrame([(1,), (77,)], "record_id bigint"), 5)
    assert gone.count() == 5 and store.read(gone, 1).count() == 0 and store.read(gone, 42).first()["name"] == "Douglas"
    assert ids(store.scan(gone, 0, 43)) == [0, 42] and ids(store.scan(gone, 0, 10**7, 2)) == [0, 42]
    assert store.occupied(gone).count() == 4
    assert tuple(store.stats(gone).first())[:3] == (4, 3, 1)
    again = store.upsert(gone, spark.createDataFrame([(1, 6, "Bob", 1)], "record_id bigint, version bigint, name string, usd bigint"))
    assert store.read(again, 1).first()["usd"] == 1 and store.live(again).count() == 4


def test_compaction_is_canonical(spark, tmp_path):
    bloated = [(i, 100 * k + i, False, "USER" + chr(65 + i % 10), i * 100 + k) for k in range(5) for i in range(100)] + [(i, 1000 + i, True, None, None) for i in range(0, 100, 2)]
    fresh = [(i, 400 + i, False, "USER" + chr(65 + i % 10), i * 100 + 4) for i in range(1, 100, 2)]
    a = store.compact(spark.createDataFrame(bloated, SCHEMA), str(tmp_path / "a"))
    b = store.compact(spark.createDataFrame(fresh, SCHEMA), str(tmp_path / "b"))
    assert a.orderBy("record_id").collect() == b.orderBy("record_id").collect()
    c = store.compact(a, str(tmp_path / "c"))
    assert c.orderBy("record_id").collect() == a.orderBy("record_id").collect()


def test_compare_and_swap(spark, records):
    writes = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (1, 1, 9), (5, 1, -1), (42, 1, 4)], "record_id bigint, seq int, expected_version bigint")
    got = {(r["record_id"], r["seq"]): r["accepted"] for r in store.compare_and_swap(records, writes).collect()}
    assert got == {(0, 1): True, (0, 2): False, (1, 1): False, (5, 1): True, (42, 1): True}


def test_transactions(spark):
    log = spark.createDataFrame([(1, 1, 10), (2, 2, 11), (3, 1, 12), (4, 3, 13)], "seq int, txn_id int, record_id int")
    assert sorted(ids(store.committed(log, spark.createDataFrame([(1,), (3,), (3,)], "txn_id int")))) == [10, 12, 13]


def test_hash_chain(spark):
    log = store.chain(spark.createDataFrame([(i, f"entry {i}") for i in range(0, 400_000, 1000)], "seq bigint, body string"), "seq", F.col("body"))
    assert log.where("prev_hash is null").count() == 1
    assert store.verify_chain(log, "seq", F.col("body")).where("not intact").count() == 0
    bad = log.withColumn("body", F.when(F.col("seq") == 150_000, "tampered").otherwise(F.col("body")))
    checked = store.verify_chain(bad, "seq", F.col("body"))
    assert [r["seq"] for r in checked.where("not intact").collect()] == [150_000]
    assert store.before_damage(checked).count() == 150
    cut = log.withColumn("prev_hash", F.when(F.col("seq") == 200_000, "0").otherwise(F.col("prev_hash")))
    assert [r["seq"] for r in store.verify_chain(cut, "seq", F.col("body")).where("not intact").collect()] == [200_000]


def test_log_positions(spark):
    log = spark.createDataFrame([(i, i % 3, "PUT") for i in range(10)], "seq bigint, record_id bigint, type string")
    assert [r["seq"] for r in store.since(log, 4, record_id=0).collect()] == [6, 9]
    assert store.truncate(log, None).count() == 10 and store.truncate(log, 0).count() == 9


def test_stride(spark):
    rows = spark.createDataFrame([([1, 30, 28],)], "t array<int>")
    assert store.within_stride(rows, "t", 15).count() == 1
    with pytest.raises(Exception, match="longer"):
        store.within_stride(rows, "t", 14).collect()


def test_joins_agree(spark):
    left = spark.createDataFrame([(i % 50, f"u{i}") for i in range(100)], "k int, name string")
    right = spark.createDataFrame([(i, i % 70) for i in range(300)], "o int, rk int")
    want = sorted((r["name"], r["o"]) for r in left.join(right, left["k"] == right["rk"]).collect())
    merged = joins.merge_join(left, right, "k", "rk")
    assert sorted((r["left"]["name"], r["right"]["o"]) for r in merged.collect()) == want
    assert "SortMergeJoin" in merged._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["name"], r["o"]) for r in joins.lookup_join(left, right, "k", "rk").collect()) == want
    assert sorted((r["name"], r["o"]) for r in joins.partitioned_join(left, right, "k", "rk", 4).collect()) == want


def test_a_large_side_is_not_broadcast(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    wide = orders.withColumn("blob", F.repeat(F.lit("x"), 10))
    old, joins.BROADCAST_BYTES = joins.BROADCAST_BYTES, 10
    try:
        plan = joins.lookup_join(wide, orders.selectExpr("o_orderkey as k"), "o_orderkey", "k").hint("merge")._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" not in plan
    finally:
        joins.BROADCAST_BYTES = old


def test_shards_and_pairs(spark):
    rows = spark.createDataFrame([(20,), (0,), (31,)], "a bigint")
    assert [r["shard"] for r in joins.nearest_shard(rows, F.col("a"), [0, 31, 10, 21]).collect()] == [3, 0, 1]
    assert joins.nearest_shard(rows.limit(1), F.lit(0).cast("bigint"), [1, 2]).first()["shard"] == 0
    values = spark.createDataFrame([(1, 10), (2, 40), (3, 17), (4, 41), (5, 90)], "id bigint, x bigint")
    assert tuple(joins.nearest_pair(values, "id", "x").first()) == (1, 2, 4)
    same = spark.createDataFrame([(7, 3), (9, 3), (8, 3), (1, 100)], "id bigint, x bigint")
    assert tuple(joins.nearest_pair(same, "id", "x").first()) == (0, 7, 8)


def test_nearest_vectors(spark):
    import random

    rng = random.Random(3)
    for n, top in ((2, 9), (40, 3), (60, 1000), (300, 100_000)):
        rows = [(i, rng.randint(-top, top), rng.randint(0, top), rng.randint(0, top)) for i in rng.sample(range(1000), n)]
        got = joins.nearest_pair_of_vectors(spark.createDataFrame(rows, "id bigint, x bigint, y bigint, z bigint"), "id", ["x", "y", "z"]).first()
        assert tuple(got) == min((sum(abs(p - q) for p, q in zip(r[1:], s[1:], strict=True)), r[0], s[0]) for r in rows for s in rows if r[0] < s[0])
    assert joins.nearest_pair_of_vectors(spark.createDataFrame([(1, 1)], "id bigint, x bigint"), "id", ["x"]).count() == 0


def test_filters(spark, records):
    assert query.parse_filter("a:b:c:d") is None and query.parse_filter("a:b:c") == ("a", "b", "c") and query.parse_filter("a:1") == ("a", "eq", "1") and query.parse_filter("a") is None
    assert ids(query.where(records, ["usd:gte:5000", "name:contains:L"])) == [0, 1_000_000]
    assert query.where(records, ["bad"]).count() == 4 and query.where(records, ["usd:contains:5"]).count() == 0
    assert query.search(records, "record_id", "usd", "7500").count() == 1 and query.search(records, "record_id", "name", "LI").count() == 2
    got = query.aggregate(records, ["usd:gt:99999"], ["sum:usd", "avg:nowhere"]).first()
    assert got["count"] == 0 and got["sum_usd"] is None and "avg_nowhere" not in got.asDict()
    assert query.Table(records, "record_id").where("usd:gt:0").max("usd").first()["max_usd"] == 10000


def test_filters_reach_the_scan(spark, sf):
    plan = query.where(spark.read.parquet(f"{sf}/orders.parquet"), ["o_custkey:gte:10"]).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_custkey,10)" in plan and "o_comment" not in plan


def test_index(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", -1, 3)], "key string, rid int, seq int")
    assert {r["key"]: r["rid"] for r in index.first_wins(rows, "key", "rid", "seq").collect()}["a"] == 1
    assert {r["key"]: r["rid"] for r in index.last_wins(rows, "key", "rid", "seq").collect()}["a"] == 2
    assert [r["rid"] for r in index.range_scan(rows, "key", "rid", "a", "c").collect()] == [1, 2]
    maps = spark.createDataFrame([({"age": "25", "name": "x"},), ({"age": "-3"},)], "m map<string,string>")
    assert index.infer_fields(maps, "m") == [("age", "BIGINT"), ("name", "STRING")]


def test_policies(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, owner int")
    rules = policy.Policies().add("t", "read", policy.owner_only).add("*", "delete", policy.owner_or_admin)
    assert [r["id"] for r in rules.view(rows, "t", "read", "owner", 7).collect()] == [1]
    assert rules.view(rows, "t", "delete", "owner", policy.ADMIN).count() == 3 and rules.view(rows, "t", "read", "owner", 7, bypass=True).count() == 3
    assert rules.view(rows, "other", "read", "owner", 9).count() == 3
    with pytest.raises(Exception, match="not permitted"):
        rules.strict(rows, "t", "read", "owner", 7).collect()


def test_grants(spark):
    records = spark.createDataFrame([(1,), (2,), (3,), (4,)], "record_id bigint")
    commands = spark.createDataFrame([(1, 0, "AUTH", 9), (1, 1, "GRANT_R", 5), (2, 0, "AUTH", 9), (2, 1, "GRANT_R", 5), (2, 2, "REVOKE", 5), (3, 0, "AUTH", 9), (3, 1, "AUTH", 5), (1, 2, "REVOKE", 6)], "record_id bigint, pos int, cmd string, arg bigint")
    assert sorted(ids(policy.readable(records, commands, 5))) == [1, 3, 4]
    assert sorted(ids(policy.readable(records, commands, 9))) == [1, 2, 4]


def test_encryption(spark):
    ship(spark)
    rows = spark.createDataFrame([(1, b"hello"), (2, b""), (3, b"x" * 100), (4, None)], "id bigint, c binary")
    sealed = rows.select("id", crypto.encrypt_with_password(F.col("c"), F.col("id"), b"salt", "pw").alias("s")).cache()
    back = sealed.select(crypto.decrypt_with_password(F.col("s"), F.col("id"), b"salt", "pw")).collect()
    assert [r[0] for r in back] == [b"hello", b"", b"x" * 100, None]
    for wrong in (crypto.decrypt_with_password(F.col("s"), F.col("id"), b"salt", "other"), crypto.decrypt_with_password(F.col("s"), F.col("id") + 1, b"salt", "pw")):
        with pytest.raises(Exception, match="wrong key"):
            sealed.where("id = 1").select(wrong).collect()


def packed(spark, column):
    r = spark.range(1).select(codec.pack(column).alias("b"), codec.pad_bits(column).alias("p"), F.size(column).alias("n")).first()
    return bytes(r["b"]), r["p"], r["n"]


def test_file_formats(spark, tmp_path):
    record = codec.encode_record(F.lit("Alice"), F.lit(-42), kinds=["word", "int"])
    raw, pad, n = packed(spark, record)
    two, pad2, _ = packed(spark, F.concat(record, record))
    (tmp_path / "main.grid").write_bytes(struct.pack(">I", pad2) + two)
    got = binary.grid(spark, str(tmp_path / "main.grid")).orderBy("record_idx").collect()
    assert [r["bit_offset"] for r in got] == [0, 5 * n] and parse.by_labels(parse.parse(got[0]["tokens"])) == {}
    assert parse.parse(got[1]["tokens"])[:2] == [("word", "Alice", None, None), ("number", None, -42, None)]

    table, data = binary.addressed_bytes([(0, raw, 5 * n), (7, raw, 5 * n)])
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "alloc.grid").write_bytes(table)
    (tmp_path / "a" / "data.grid").write_bytes(data)
    found = binary.addressed(spark, str(tmp_path / "a")).orderBy("record_id").collect()
    assert [(r["record_id"], r["bit_length"], r["flag"]) for r in found] == [(0, 5 * n, 1), (7, 5 * n, 1)] and found[0]["tokens"] == got[0]["tokens"]

    stride = 256
    slot = lambda b: b + bytes(stride // 8 - len(b))
    gone, _, _ = packed(spark, F.array(F.lit(0), F.lit(30), F.lit(28)))
    (tmp_path / "pos.grid").write_bytes(struct.pack(">III", binary.POSITIONED_MAGIC, stride, 3) + slot(raw) + slot(b"") + slot(gone))
    slots = binary.positioned(spark, str(tmp_path / "pos.grid")).orderBy("record_id").collect()
    assert [(r["record_id"], r["flag"]) for r in slots] == [(0, 1), (2, 2)] and slots[0]["tokens"] == got[0]["tokens"]

    def entries(magic, head, prev, tail=True):
        out = b""
        for h in head:
            content = struct.pack(">4s" + "I" * len(h), magic, *h) + prev + raw + (struct.pack(">I", pad) if tail else b"")
            out += content + hashlib.sha256(content).digest()
        return out

    minus = struct.pack(">i", -1)
    logs = {"a.wal": entries(b"GDBW", [(0, n), (1, n)], minus), "b.wal": entries(b"GPWL", [(5, 9, n)], minus), "c.wal": entries(b"TXNW", [(3, 4, n)], struct.pack(">i", 2)), "d.wal": entries(b"WALG", [(4, n, pad)], b"", tail=False)}
    damaged = bytearray(logs["a.wal"])
    damaged[20] ^= 1
    (tmp_path / "logs").mkdir()
    for name, content in {**logs, "e.wal": bytes(damaged), "f.wal": logs["a.wal"][:-5]}.items():
        (tmp_path / "logs" / name).write_bytes(content)
    rows = {}
    for r in binary.log(spark, str(tmp_path / "logs")).collect():
        rows.setdefault(r["path"][-5], []).append(r)
    assert [r["seq"] for r in sorted(rows["a"], key=lambda r: r["seq"])] == [0, 1] and all(r["intact"] and r["tokens"] == got[0]["tokens"] for k in "abcd" for r in rows[k])
    assert (rows["b"][0]["record_id"], rows["c"][0]["txn_id"], rows["c"][0]["flag"], rows["d"][0]["record_id"]) == (9, 3, 2, 4)
    assert sorted(r["intact"] for r in rows["e"]) == [False, True] and len(rows["f"]) == 1


def test_archive_round_trip(spark, tmp_path):
    files = spark.createDataFrame([(0, "read_me.txt", b"hello\x00\xff"), (1, "empty.bin", b"")], "idx bigint, name string, content binary")
    records = binary.archive_records(files).select("record_id", codec.pack(F.col("tokens")).alias("b"), F.size("tokens").alias("n")).orderBy("record_id").collect()
    table, data = binary.addressed_bytes([(r["record_id"], bytes(r["b"]), 5 * r["n"]) for r in records])
    (tmp_path / "x.arc").write_bytes(struct.pack(">4sIII", b"ANY!", 4, len(records), len(table)) + table + data)
    got = binary.archive(spark, str(tmp_path / "x.arc")).orderBy("name").collect()
    assert [(r["name"], r["size"], bytes(r["content"])) for r in got] == [("empty.bin", 0, b""), ("read_me.txt", 7, b"hello\x00\xff")]


def test_objects(spark):
    files = spark.createDataFrame([("a/1", b"x"), ("a/2", b"yy"), ("b/1", b"x")], "path string, content binary")
    held = objects.objects(files, "k", 7)
    assert [r["path"] for r in objects.listing(held, "k", "a/").collect()] == ["a/1", "a/2"]
    newer = objects.upload(held, objects.objects(spark.createDataFrame([("a/1", b"new")], "path string, content binary"), "k", 8))
    assert newer.count() == 3 and bytes(objects.download(newer, "k", "a/1").first()["content"]) == b"new"
    assert objects.download(newer, "k", "a/1", user=7).count() == 0 and objects.remove(newer, "k", "a/2").count() == 2
