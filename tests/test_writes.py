"""Transactions, checked and fluent writes, held rows, limits by two keys, files of fixed strides, single files and archives."""

import random
import struct
from datetime import datetime, timedelta

import pytest
from lodestone.functions import clients, codec, parse
from lodestone.operators import index, joins, policy, query, store
from lodestone.operators.transactions import TransactionalStore
from lodestone.session import ship
from lodestone.sources import binary
from lodestone.streaming import feeds
from pyspark.sql import functions as F

WRITES = "record_id bigint, tokens array<int>"


def values(df):
    return {r["record_id"]: r["tokens"][0] for r in df.collect()}


def test_transactions(spark, tmp_path):
    held = TransactionalStore(spark, str(tmp_path))
    rows = lambda *pairs: spark.createDataFrame([(i, [v, 30, 28]) for i, v in pairs], WRITES)
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "record_id bigint")
    first = held.begin()
    first.put(rows((1, 1), (2, 2), (3, 3)))
    assert values(held.state()) == {}  # nothing is seen before the commit
    with pytest.raises(RuntimeError):
        held.begin()
    held.delete(ids(3))  # joins the open transaction
    first.commit()
    assert values(held.state()) == {1: 1, 2: 2}
    for late in (first.commit, first.rollback, lambda: first.put(rows((9, 9)))):
        with pytest.raises(RuntimeError):
            late()
    second = held.begin()
    second.put(rows((1, 7))).delete(ids(2))
    second.rollback()
    assert values(held.state()) == {1: 1, 2: 2}
    pairs = spark.createDataFrame([(1, 2, [2, 30, 28], [1, 30, 28])], "from_id bigint, to_id bigint, from_tokens array<int>, to_tokens array<int>")
    held.begin().swap(pairs).commit()
    assert values(held.state()) == {1: 2, 2: 1}
    held.put(rows((5, 5)))  # outside: committed at once
    held.begin().put(rows((1, 9)))  # a crash: never ended
    again = TransactionalStore(spark, str(tmp_path))
    assert values(again.state()) == values(again.state()) == {1: 2, 2: 1, 5: 5}
    assert values(again.read(5)) == {5: 5} and values(again.scan(0, 2)) == {1: 2} and again.read(3).count() == 0
    stats = again.stats().first()
    assert (stats["allocated"], stats["tombstones"], stats["txn_count"], stats["free"], stats["data_bits"], stats["data_bytes"]) == (3, 1, 3, 2, 45, 6)


def test_held_rows_follow_writes(spark):
    base = spark.createDataFrame([(1, 1, False, 5), (2, 1, False, 6)], "record_id int, version int, is_deleted boolean, v int")
    held = store.Cached(base)
    assert held.read(1).first()["v"] == 5 and held.live().storageLevel.useMemory
    held.write(spark.createDataFrame([(1, 2, 50)], "record_id int, version int, v int"))
    assert held.held is None and held.read(1).first()["v"] == 50
    held.delete(spark.createDataFrame([(2,)], "record_id int"), 3)
    assert held.read(2).count() == 0 and held.live().count() == 1
    held.invalidate()


def test_policy_actions(spark):
    rules = policy.Policies().add("t", "write", policy.owner_only).add("t", "create", policy.public_read).add("t", "delete", policy.owner_only)
    there = spark.createDataFrame([(1, 7), (2, 8)], "record_id int, owner int")
    writes = spark.createDataFrame([(1,), (2,), (3,)], "record_id int")
    got = {r["record_id"]: (r["action"], r["permitted"]) for r in rules.writes(there, writes, "t", "owner", 7).collect()}
    assert got == {1: ("write", True), 2: ("write", False), 3: ("create", True)}
    assert [r["record_id"] for r in rules.view(there, "t", "delete", "owner", 7).collect()] == [1]


def test_owners_in_records(spark):
    ship(spark)
    there = spark.createDataFrame([(1, [7, 5]), (2, [8, 5])], "record_id int, vec array<bigint>")
    writes = spark.createDataFrame([(1,), (2,), (3,)], "record_id int").withColumn("tokens", codec.encode_record(F.lit(9)))
    rows = policy.write_as(there, writes, 7).withColumn("v", parse.value_vector(parse.parsed("tokens"))).collect()
    assert {r["record_id"]: r["accepted"] for r in rows} == {1: True, 2: False, 3: True} and all(r["v"] == [7, 9] for r in rows)
    assert all(r["accepted"] for r in policy.write_as(there, writes, 7, bypass=True).collect())
    assert {r["record_id"]: r["accepted"] for r in policy.delete_as(there, writes, 8).collect()} == {1: False, 2: True, 3: True}


def test_fluent_writes(spark):
    base = query.Table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    h = base.get(1).select(base.hash().alias("h")).first()["h"]
    one = base.update(1, if_match=h, v="x")
    two = one.update(1, if_match=h, v="lost").insert(spark.createDataFrame([(2, "no"), (3, "c")], "k int, v string")).delete(2).update(9, v="nobody")
    assert sorted(map(tuple, two.rows().collect())) == [(1, "x"), (3, "c")] and two.where("v:eq:x").rows().count() == 1


def test_two_limits(spark):
    """Against a walk through all events with both buckets."""
    ship(spark)
    rng, t = random.Random(4), datetime(2024, 1, 1)
    rows, at = [], t
    for i in range(600):
        at += timedelta(seconds=rng.random() * 4)
        rows.append((i, at, rng.choice("abcde"), rng.choice(["u1", "u2", "u3", "u4", None])))
    rows += [(1000 + i, t + timedelta(seconds=i), "lonely", None) for i in range(30)]
    want, ips, users = {}, {}, {}
    for i, ts, ip, user in sorted(rows, key=lambda r: (r[1], r[0])):
        now = ts.timestamp()
        a = ips[ip] = [x for x in ips.get(ip, []) if now - x < 20]
        if len(a) >= 3:
            want[i] = False, max(0, int(20 - (now - a[0])))
            continue
        a.append(now)
        if user:
            b = users[user] = [x for x in users.get(user, []) if now - x < 20]
            if len(b) >= 4:
                a.pop()
                want[i] = False, max(0, int(20 - (now - b[0])))
                continue
            b.append(now)
        want[i] = True, 0
    events = spark.createDataFrame(rows, "id bigint, ts timestamp, ip string, user string").repartition(5)
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in feeds.rate_limit_dual(events, "ip", "user", "ts", "id", 3, 4, 20.0).collect()}
    assert got == want
    single = feeds.rate_limit(events, "ip", "ts", "id", 3, 20.0, retry=True).collect()
    assert all((r["retry_after"] == 0) or not r["allowed"] for r in single) and any(r["retry_after"] > 0 for r in single)


def test_presence_by_channel(spark):
    t = datetime(2024, 1, 1)
    beats = spark.createDataFrame([("a", t, "x"), ("a", t + timedelta(seconds=5), "y"), ("b", t, "x"), ("c", t - timedelta(seconds=99), "x")], "user string, ts timestamp, channel string")
    got = feeds.presence(beats, "user", "ts", F.lit(t + timedelta(seconds=10)), 30, channel="channel", name="x")
    assert [r["user"] for r in got.collect()] == ["b"]


def test_following_has_no_gap(spark, tmp_path):
    folder, place, seen = str(tmp_path / "in"), str(tmp_path / "c"), []
    write = lambda lo, hi: spark.range(lo, hi).selectExpr("id as seq").write.mode("append").parquet(folder)
    run = lambda: feeds.commit_batches(feeds.follow(spark, folder, "seq bigint", 3, files=1), lambda df, n: seen.extend(r["seq"] for r in df.collect()), place).awaitTermination()
    write(0, 6)
    run()
    write(6, 9)
    run()
    assert sorted(seen) == [4, 5, 6, 7, 8]


def test_fixed_strides(spark, tmp_path):
    ship(spark)
    rows = spark.createDataFrame([(0, 1, 5), (9, 1, 6), (10, 1, 7), (25, 1, 8), (9, 2, None)], "record_id bigint, version int, v int")
    rows = rows.withColumn("tokens", F.when(F.col("v").isNull(), F.array(*[F.lit(c) for c in binary.DELETED])).otherwise(codec.encode_record(F.col("v")))).drop("v")
    binary.write_positioned(rows, str(tmp_path / "p"), stride_bits=64, slots=10)
    files = spark.read.parquet(str(tmp_path / "p"))
    back = binary.positioned_rows(files.withColumn("path", F.lit("f"))).orderBy("record_id").collect()
    assert [(r["record_id"], r["flag"], r["tokens"]) for r in back] == [(0, 1, [5, 30, 28]), (9, 2, [0, 30, 28]), (10, 1, [7, 30, 28]), (25, 1, [8, 30, 28])]
    assert all(struct.unpack(">III", bytes(r["content"])[:12])[:2] == (0x47524450, 64) for r in files.collect())
    with pytest.raises(Exception, match="stride"):
        binary.write_positioned(rows.withColumn("tokens", F.array_repeat(F.lit(1), 20)), str(tmp_path / "q"), stride_bits=64)


def test_single_files(spark, tmp_path):
    pack = lambda codes: (int("".join(f"{c:05b}" for c in codes), 2) << (-5 * len(codes) % 8)).to_bytes((5 * len(codes) + 7) // 8, "big")
    one, two, three = ([v, 30, 28] for v in (1, 2, 3))
    data = pack(one) + pack(two)
    at = 64 + 3 * 16
    table = struct.pack(">QII", at, 15, 1) + struct.pack(">QII", at + 2, 15, 2) + bytes(16)
    late = struct.pack(">4siII", b"WALG", 2, 3, 1) + pack(three)
    head = struct.pack(">IIQQQ", 0x47524442, 1, len(table), len(data), 0).ljust(64, b"\0")
    (tmp_path / "s.grid").write_bytes(head + table + data + late + late[:10])
    got = binary.single(spark, str(tmp_path / "s.grid")).orderBy("record_id").collect()
    assert [(r["record_id"], r["bit_length"], r["flag"], r["tokens"]) for r in got] == [(0, 15, 1, one), (1, 15, 2, two), (2, 15, 1, three)]
    (tmp_path / "bad.grid").write_bytes(bytes(64))
    with pytest.raises(Exception, match="single-file"):
        binary.single(spark, str(tmp_path / "bad.grid")).collect()


def test_archives(spark, tmp_path):
    ship(spark)
    rows = [(i, "".join(chr(97 + int(c)) for c in str(i)) + "_x.bin", bytes(range(i % 7))) for i in range(23)]
    binary.write_archives(spark.createDataFrame(rows, "idx bigint, name string, content binary").repartition(3), str(tmp_path / "a"), each=5)
    files = spark.read.parquet(str(tmp_path / "a"))
    assert files.count() == 5
    back = binary.archive_rows(files.select(F.col("part").cast("string").alias("path"), "content")).collect()
    assert sorted((r["name"], bytes(r["content"])) for r in back) == sorted((n, c) for _, n, c in rows)


def test_grids_of_bounded_size(spark, tmp_path, monkeypatch):
    ship(spark)
    monkeypatch.setattr(binary, "GRID_TOKENS", 40)
    rows = spark.range(300).select(F.col("id").alias("record_idx"), codec.encode_record(F.col("id") * 7).alias("tokens"))
    binary.write_grid(rows, str(tmp_path / "g"))
    files = spark.read.parquet(str(tmp_path / "g")).collect()
    assert len(files) > 20 and all(len(r["content"]) <= 4 + 40 * 5 // 8 + 8 for r in files)
    back = binary.grid_rows(spark.read.parquet(str(tmp_path / "g")).select(F.col("part").cast("string").alias("path"), "content"))
    assert sorted(parse.parse(r["tokens"])[0][2] for r in back.collect()) == [7 * i for i in range(300)]


def test_ordered_join(spark):
    left, right = spark.range(200).selectExpr("id as a").repartition(7), spark.range(0, 400, 2).selectExpr("id as b").repartition(5)
    got = [r["left"]["a"] for r in joins.merge_join(left, right, "a", "b", ordered=True).collect()]
    assert got == list(range(0, 200, 2))


def test_json_writes(spark):
    ship(spark)
    fields = [("name", "word"), ("n", "int")]
    none = spark.createDataFrame([], "record_id bigint, version bigint, is_deleted boolean, tokens array<int>")
    bodies = spark.createDataFrame([('{"_id": 7, "name": "Ann"}',), ('{"name": "Bob", "n": 2}',), ('{"n": 3}',)], "body string")
    held = store.create_json(none, bodies, fields, 1)
    text = lambda df: {r["record_id"]: r["t"] for r in store.live(df).select("record_id", parse.text_of(parse.parsed("tokens")).alias("t")).collect()}
    got = text(held)
    assert got[7] == "Ann" and sorted(got) == [7, 8, 9] and sorted([got[8], got[9]]) == ["3", "Bob2"]
    writes = spark.createDataFrame([(7, '{"name": "Cy"}', "stale"), (8, '{"name": "Di"}', None)], "record_id bigint, body string, if_match string")
    held = store.delete(store.update_json(held, writes, fields, 2), spark.createDataFrame([(9,)], "record_id bigint"), 3)
    assert text(held) == {7: "Ann", 8: "Di"}


def test_label_indexes(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"a": "x", "n": "5"}, 1), (2, {"a": "y", "n": "17"}, 1)], "id bigint, labels map<string,string>, version int")
    index.index_labels(rows, "id", "labels", str(tmp_path / "i"))
    index.index_labels(spark.createDataFrame([(1, {"a": "y"}, 2)], rows.schema), "id", "labels", str(tmp_path / "i"))
    assert sorted(r[0] for r in index.lookup(spark, str(tmp_path / "i"), "a", "y").collect()) == [1, 2] and index.lookup(spark, str(tmp_path / "i"), "a", "x").count() == 0
    assert [tuple(r) for r in index.between(spark, str(tmp_path / "i"), "n", 5, 17).collect()] == [(1, 5)]


def test_scales_of_streams(spark):
    ship(spark)
    codes = codec.encode_expression(-1234, "S", 3, "+", 5)
    got = spark.range(1).select(parse.scaled_values(codes)).first()[0]
    assert [(int(v["numerator"]), v["scale"]) for v in got] == [(-1234, 3), (5, 0)]


def test_clients(spark):
    df = spark.createDataFrame([], "id bigint not null, name string, tags array<string>, m map<string,double>, ok boolean, class string")
    scope = {}
    exec(clients.python_client(df.schema, "my-table"), scope)
    row = scope["MyTable"](id=1)
    assert row.id == 1 and row.name is None and not hasattr(row, "class")
    text = clients.typescript_client(df.schema, "my-table")
    assert 'export interface MyTable {' in text and '"tags"?: string[];' in text and '"m"?: Record<string, number>;' in text and '"id": number;' in text
