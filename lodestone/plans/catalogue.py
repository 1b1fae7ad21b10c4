"""The query catalogue: one entry for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import arith, codec, geometry, integrity, parse
from ..operators import index, joins, policy, query, store
from ..session import shared_dir, ship, table
from ..sources import objects
from ..streaming import feeds

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def entry(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


# Filters and aggregates.


@entry("select count(*) as count, avg(c_acctbal) as avg_c_acctbal from customer where c_acctbal > 0 and lower(c_mktsegment) = 'building'")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.aggregate(table(spark, sf_dir, "customer"), ["c_acctbal:gt:0", "c_mktsegment:eq:building"], ["avg:c_acctbal"])


def _filter_query(name: str, table_name: str, filters: list[str], columns: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query.where(table(spark, sf_dir, table_name), filters).select(*columns)

    run.__name__ = name
    entry(f"select {', '.join(columns)} from {table_name} where {sql}")(run)


_filter_query("filter_eq", "lineitem", ["l_linenumber:eq:3"], ["l_orderkey", "l_partkey"], "l_linenumber = 3")
_filter_query("filter_gt", "customer", ["c_acctbal:gt:5000"], ["c_custkey", "c_acctbal"], "c_acctbal > 5000")
_filter_query("filter_gte", "customer", ["c_nationkey:gte:20"], ["c_custkey", "c_nationkey"], "c_nationkey >= 20")
_filter_query("filter_lt", "customer", ["c_acctbal:lt:-500.5"], ["c_custkey", "c_acctbal"], "c_acctbal < -500.5")
_filter_query("filter_lte", "customer", ["c_nationkey:lte:3"], ["c_custkey", "c_nationkey"], "c_nationkey <= 3")
_filter_query("filter_str_eq", "customer", ["c_mktsegment:BuIlDiNg"], ["c_custkey"], "lower(c_mktsegment) = 'building'")
_filter_query("filter_str_contains", "part", ["p_name:contains:A"], ["p_partkey", "p_name"], "contains(lower(p_name), 'a')")
_filter_query("filter_str_starts", "part", ["p_brand:startsWith:brand#1"], ["p_partkey", "p_brand"], "starts_with(lower(p_brand), 'brand#1')")
_filter_query("filter_conj", "customer", ["c_acctbal:gt:0", "c_nationkey:lt:10", "c_mktsegment:contains:o"], ["c_custkey"], "c_acctbal > 0 and c_nationkey < 10 and contains(lower(c_mktsegment), 'o')")
_filter_query("filter_missing_field", "customer", ["nowhere:gt:0"], ["c_custkey"], "false")
_filter_query("filter_bad_number", "customer", ["c_acctbal:gt:abc"], ["c_custkey"], "false")
_filter_query("filter_unknown_op", "customer", ["c_mktsegment:gt:a"], ["c_custkey"], "false")
_filter_query("index_range_filter", "orders", ["o_custkey:gte:10", "o_custkey:lt:50"], ["o_orderkey", "o_custkey"], "o_custkey >= 10 and o_custkey < 50")


@entry("select p_partkey, p_name from part where contains(lower(concat(p_name, p_brand, p_type)), 'brand#1') order by p_partkey limit 20")
def search_limit(spark, sf_dir):
    return query.search(table(spark, sf_dir, "part"), "p_partkey", "p_name", "Brand#1").select("p_partkey", "p_name")


@entry("select p_partkey from part where cast(p_size as varchar) = '7' order by p_partkey limit 20")
def search_number(spark, sf_dir):
    return query.search(table(spark, sf_dir, "part"), "p_partkey", "p_size", "7").select("p_partkey")


@entry("select o_orderkey from orders order by o_orderkey limit 100")
def list_first(spark, sf_dir):
    return query.first_rows(table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey")


@entry("select o_orderkey, o_custkey from orders where substr(sha256(cast(o_orderkey as varchar)), 1, 16) = substr(sha256('42'), 1, 16)")
def by_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(integrity.text_hash(F.col("o_orderkey").cast("string")) == integrity.text_hash(F.lit("42"))).select("o_orderkey", "o_custkey")


@entry("select o_orderkey from orders where substr(sha256(cast(o_orderkey as varchar)), 1, 16) <> substr(sha256('42'), 1, 16)")
def conditional_get(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(integrity.text_hash(F.col("o_orderkey").cast("string")) != integrity.text_hash(F.lit("42"))).select("o_orderkey")


@entry("select count(*) as count from lineitem where l_quantity > 25")
def agg_count(spark, sf_dir):
    return query.Table(table(spark, sf_dir, "lineitem"), "l_orderkey").where("l_quantity:gt:25").count()


@entry("select sum(l_quantity) as sum_l_quantity, count(*) as count from lineitem")
def agg_sum(spark, sf_dir):
    return query.Table(table(spark, sf_dir, "lineitem"), "l_orderkey").sum("l_quantity")


@entry("select avg(l_quantity) as avg_l_quantity, count(*) as count from lineitem")
def agg_avg(spark, sf_dir):
    return query.Table(table(spark, sf_dir, "lineitem"), "l_orderkey").avg("l_quantity")


@entry("select min(l_extendedprice) as min_l_extendedprice, count(*) as count from lineitem")
def agg_min(spark, sf_dir):
    return query.Table(table(spark, sf_dir, "lineitem"), "l_orderkey").min("l_extendedprice")


@entry("select max(l_extendedprice) as max_l_extendedprice, count(*) as count from lineitem")
def agg_max(spark, sf_dir):
    return query.Table(table(spark, sf_dir, "lineitem"), "l_orderkey").max("l_extendedprice")


@entry("select count(*) as count, sum(l_quantity) as sum_l_quantity, avg(l_quantity) as avg_l_quantity, min(l_discount) as min_l_discount, max(l_tax) as max_l_tax from lineitem where l_quantity >= 10 and lower(l_returnflag) = 'r'")
def agg_multi(spark, sf_dir):
    return query.aggregate(table(spark, sf_dir, "lineitem"), ["l_quantity:gte:10", "l_returnflag:eq:R"], ["sum:l_quantity", "avg:l_quantity", "min:l_discount", "max:l_tax"])


@entry("select user_id, cast(coalesce(sum(case when event_type = 'purchase' then cast(round(value * 100) as bigint) when event_type = 'error' then -cast(round(value * 100) as bigint) end), 0) as bigint) as balance from events group by user_id")
def ledger_balance(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("cents", _cents("value"))
    return query.ledger_balance(events, ["user_id"], "event_type", "cents", "PURCHASE", "ERROR")


@entry("select event_id, user_id from events where user_id = 7 order by event_id limit 10")
def recent_txs(spark, sf_dir):
    return query.first_rows(table(spark, sf_dir, "events").where("user_id = 7"), "event_id", 10).select("event_id", "user_id")


@entry("select sum(cast(round(c_acctbal * 100) as bigint))::bigint as total from customer")
def conservation(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.sum(_cents("c_acctbal")).alias("total"))


@entry("select c_custkey, count(o_orderkey) as n, cast(coalesce(sum(cast(round(o_totalprice * 100) as bigint)), 0) as bigint) as total, count(o_orderkey) > 0 as has_any from customer left join orders on c_custkey = o_custkey group by c_custkey")
def counts_with_zero(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", _cents("o_totalprice").alias("cents"))
    return query.counts_with_zero(table(spark, sf_dir, "customer"), orders, "c_custkey", "o_custkey", "cents")


@entry("select user_id, arg_max(event_type, event_id) as last_type from events group by user_id")
def last_value(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"))


@entry(
    """select tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) as accuracy, case when tp + fp > 0 then tp / (tp + fp) end as precision, case when tp + fn > 0 then tp / (tp + fn) end as recall
    from (select count(*) filter (quality = 1 and toxic = 0) as tp, count(*) filter (quality = 0 and toxic = 0) as fp, count(*) filter (quality = 1 and toxic = 1) as fn, count(*) filter (quality = 0 and toxic = 1) as tn from labels)"""
)
def match_metrics(spark, sf_dir):
    return query.match_metrics(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


@entry("select max(event_id) + 1 as next_id from events")
def next_free_id(spark, sf_dir):
    return table(spark, sf_dir, "events").agg((F.max("event_id") + 1).alias("next_id"))


# Records: versions, transactions, logs.


def _versions(spark, sf_dir) -> DataFrame:
    """Events as versions of their user's record; every error event deletes it."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("is_deleted"), "event_type", _cents("value").alias("cents"))


VERSIONS = "(select user_id as record_id, event_id as version, event_type = 'error' as is_deleted, event_type, cast(round(value * 100) as bigint) as cents from events)"
LATEST = f"(select * from {VERSIONS} qualify row_number() over (partition by record_id order by version desc) = 1)"


@entry("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 42")
def point_read(spark, sf_dir):
    return query.Table(table(spark, sf_dir, "orders"), "o_orderkey").get(42).select("o_orderkey", "o_custkey", "o_totalprice")


@entry(f"select * from {LATEST} where record_id = 7 and not is_deleted")
def point_read_version(spark, sf_dir):
    return store.read(_versions(spark, sf_dir), 7)


@entry("select o_orderkey, o_custkey from orders where o_orderkey >= 100 and o_orderkey < 200 order by o_orderkey")
def scan_range(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey as record_id", "o_custkey", "1L as version", "false as is_deleted")
    return store.scan(rows, 100, 200).selectExpr("record_id as o_orderkey", "o_custkey")


@entry("select o_orderkey as record_id, o_custkey from orders where o_orderkey % 7 <> 0")
def scan_after_delete(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey as record_id", "o_custkey", "1L as version", "false as is_deleted")
    gone = store.delete(rows, rows.where("record_id % 7 = 0"), 2)
    return store.live(gone).select("record_id", "o_custkey")


@entry(f"select * from {LATEST}")
def latest_version(spark, sf_dir):
    return store.latest(_versions(spark, sf_dir))


@entry(f"select record_id, cents from {LATEST} where not is_deleted and record_id not in (select user_id from events where event_type = 'signup') union all select distinct user_id as record_id, cast(0 as bigint) as cents from events where event_type = 'signup'")
def upsert(spark, sf_dir):
    versions = _versions(spark, sf_dir)
    resets = versions.where("event_type = 'signup'").select("record_id").distinct().selectExpr("record_id", "9000000000L as version", "'reset' as event_type", "0L as cents")
    return store.live(store.upsert(versions, resets)).select("record_id", "cents")


@entry(
    f"""select w.record_id, w.seq, w.expected_version, w.expected_version = l.version as accepted from (select record_id, seq, case when seq = 1 then version else version - 1 end as expected_version from {LATEST} cross join (values (1), (2)) t(seq)) w join {LATEST} l using (record_id)"""
)
def cas_batch(spark, sf_dir):
    versions = _versions(spark, sf_dir)
    current = store.latest(versions).select("record_id", "version")
    writes = current.select("record_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "version").select("record_id", "seq", F.when(F.col("seq") == 1, F.col("version")).otherwise(F.col("version") - 1).alias("expected_version"))
    return store.compare_and_swap(versions, writes)


@entry("select event_id, user_id from events where user_id in (select user_id from events where event_type = 'purchase')")
def txn_visible(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "txn_id")
    return store.committed(events, events.where("event_type = 'purchase'")).selectExpr("event_id", "txn_id as user_id")


@entry(f"select * from {LATEST} where not is_deleted order by record_id")
def compact(spark, sf_dir):
    return store.compact(_versions(spark, sf_dir), shared_dir(spark)).orderBy("record_id")


@entry("select distinct user_id as record_id from events")
def occupied_rows(spark, sf_dir):
    return store.occupied(_versions(spark, sf_dir))


BITS = "5 * (length(cast(record_id as varchar)) + 2)"


@entry(
    f"""select count(*) as total, count(*) filter (not is_deleted) as allocated, count(*) filter (is_deleted) as tombstones, cast(coalesce(sum({BITS}) filter (not is_deleted), 0) as bigint) as data_bits,
    cast(max(record_id) + 1 - count(*) as bigint) as free, cast(ceil(coalesce(sum({BITS}) filter (not is_deleted), 0) / 8.0) as bigint) as data_bytes from {LATEST}"""
)
def store_stats(spark, sf_dir):
    return store.stats(_versions(spark, sf_dir).withColumn("tokens", codec.encode_record(F.col("record_id"))), "tokens")


@entry("select o_orderkey, o_totalprice from orders where o_totalprice > 100000 order by o_orderkey limit 1")
def find_first(spark, sf_dir):
    return query.find_first(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice") > 100000).select("o_orderkey", "o_totalprice")


@entry("select event_id, sha256(concat(event_id, '|', user_id, '|', event_type)) as sha256, lag(sha256(concat(event_id, '|', user_id, '|', event_type))) over (order by event_id) as prev_hash, true as intact from events")
def chain_verify(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    content = F.concat_ws("|", "event_id", "user_id", "event_type")
    return store.verify_chain(store.chain(events, "event_id", content), "event_id", content).select("event_id", "sha256", "prev_hash", "intact")


@entry("select event_id, user_id from events where event_id > 900 order by event_id")
def replay_after_checkpoint(spark, sf_dir):
    return store.truncate(table(spark, sf_dir, "events"), 900, "event_id").select("event_id", "user_id").orderBy("event_id")


@entry("select max(event_id) as checkpoint_seq from events")
def checkpoint_seq(spark, sf_dir):
    return store.checkpoint(_versions(spark, sf_dir))[1]


@entry("select event_id from events order by event_id desc limit 10")
def log_recent(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id").orderBy(F.desc("event_id")).limit(10)


@entry("select event_type as table_name, event_id, (dense_rank() over (order by f, event_type) - 1) * 10000000 + event_id as record_id from (select *, min(event_id) over (partition by event_type) as f from events)")
def table_namespaces(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_type as table_name", "event_id", "event_id as first_use", "event_id as local_id")
    return store.resolve_table(rows).select("table_name", "event_id", "record_id")


# Joins.


@entry("select c_custkey, c_name, o_orderkey from customer join orders on c_custkey = o_custkey")
def merge_join(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.merge_join(customer, orders, "c_custkey", "o_custkey").select("left.c_custkey", "left.c_name", "right.o_orderkey")


@entry("select n_name, count(*) as n from nation join customer on n_nationkey = c_nationkey group by n_name")
def broadcast_join(spark, sf_dir):
    both = joins.lookup_join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "customer").select("c_nationkey"), "n_nationkey", "c_nationkey")
    return both.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@entry("select c_custkey, o_orderkey from customer join orders on c_custkey = o_custkey")
def partitioned_join(spark, sf_dir):
    return joins.partitioned_join(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")


@entry("select e.event_id, c.c_name from events e left join customer c on e.user_id = c.c_custkey")
def mapping_lookup(spark, sf_dir):
    events, customer = table(spark, sf_dir, "events").select("event_id", "user_id"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return events.join(customer, events["user_id"] == customer["c_custkey"], "left").select("event_id", "c_name")


@entry("with v as (select c_custkey as k, cast(round(c_acctbal * 100) as bigint) as x from customer), p as (select lag(k) over (order by x, k) as ka, lag(x) over (order by x, k) as xa, k as kb, x as xb from v) select xb - xa as distance, least(ka, kb) as a, greatest(ka, kb) as b from p where ka is not null order by 1, 2, 3 limit 1")
def nearest_pair(spark, sf_dir):
    return joins.nearest_pair(table(spark, sf_dir, "customer").select("c_custkey", _cents("c_acctbal").alias("x")), "c_custkey", "x")


PRICED = "(select p_partkey, p_size::bigint as s, cast(round(p_retailprice * 100) as bigint) as r from part)"


@entry(f"select min(abs(x.s - y.s) + abs(x.r - y.r)) as distance, arg_min(x.p_partkey, (abs(x.s - y.s) + abs(x.r - y.r)) * 1e12 + x.p_partkey * 1e6 + y.p_partkey) as a, arg_min(y.p_partkey, (abs(x.s - y.s) + abs(x.r - y.r)) * 1e12 + x.p_partkey * 1e6 + y.p_partkey) as b from {PRICED} x join {PRICED} y on x.p_partkey < y.p_partkey")
def nearest_pair_vectors(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("s"), _cents("p_retailprice").alias("r"))
    return joins.nearest_pair_of_vectors(part, "p_partkey", ["s", "r"])


@entry("select s_suppkey, arg_min(i, bit_count(xor(s_suppkey, a)) * 10 + i) as shard from supplier cross join (values (0, 0::bigint), (1, 31::bigint), (2, 10::bigint), (3, 21::bigint)) t(i, a) group by s_suppkey")
def nearest_shard(spark, sf_dir):
    return joins.nearest_shard(table(spark, sf_dir, "supplier").select("s_suppkey"), F.col("s_suppkey"), [0, 31, 10, 21])


# Distances.

VECTOR = "abs(cast(l_quantity as bigint) - 20) + abs(l_linenumber - 3)"


@entry(f"select l_orderkey, l_linenumber, {VECTOR} as distance from lineitem where {VECTOR} < 4")
def manhattan_radius(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    return rows.where(geometry.within(["q", "l_linenumber"], [20, 3], 4)).select("l_orderkey", "l_linenumber", geometry.manhattan_columns(["q", "l_linenumber"], [20, 3]).cast("bigint").alias("distance"))


EMBEDDED = "(select vec_id, list_sum(list_transform(embedding, lambda x: abs(cast(round(x * 1000) as bigint) - 100)))::bigint as distance from embeddings)"


def _embedded(spark, sf_dir) -> DataFrame:
    vec = F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("bigint"))  # floats stay floats, as in the SQL
    return table(spark, sf_dir, "embeddings").select("vec_id", vec.alias("vec"))


@entry(f"select vec_id, distance from {EMBEDDED} order by distance, vec_id")
def manhattan_rank(spark, sf_dir):
    return query.nearest(_embedded(spark, sf_dir), geometry.manhattan(F.col("vec"), geometry.vector([100] * 64)), "vec_id").select("vec_id", "distance")


@entry(f"select vec_id, distance from {EMBEDDED} order by distance, vec_id limit 5")
def manhattan_topk(spark, sf_dir):
    return query.nearest(_embedded(spark, sf_dir), geometry.manhattan(F.col("vec"), geometry.vector([100] * 64)), "vec_id", 5).select("vec_id", "distance")


# Indexes.


@entry("select c_custkey, cast(cast('0x' || substr(sha256(c_name), 1, 16) as ubigint) % 64 as bigint) as bucket from customer")
def hash_bucket(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", integrity.hash_bucket(F.col("c_name"), 64).alias("bucket"))


@entry("select c_custkey, cast(cast('0x' || substr(sha256(c_name), 1, 8) as bigint) % 999999 + 1 as bigint) as tenant_id from customer")
def tenant_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", (integrity.hash_id(F.col("c_name"), 999_999) + 1).alias("tenant_id"))


@entry("select o_custkey, o_orderkey from orders where o_custkey >= 20 and o_custkey < 35 order by o_custkey, o_orderkey")
def btree_range(spark, sf_dir):
    return index.range_scan(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 20, 35)


@entry("select o_custkey, arg_max(o_orderkey, o_orderkey) as o_orderkey from orders group by o_custkey")
def btree_last_wins(spark, sf_dir):
    return index.last_wins(table(spark, sf_dir, "orders").withColumn("seq", F.col("o_orderkey")), "o_custkey", "o_orderkey", "seq")


@entry("select o_custkey, arg_min(o_orderkey, o_orderkey) as o_orderkey from orders group by o_custkey")
def hash_first_wins(spark, sf_dir):
    return index.first_wins(table(spark, sf_dir, "orders").withColumn("seq", F.col("o_orderkey")), "o_custkey", "o_orderkey", "seq")


@entry("select o_orderkey from orders where o_custkey < 50 intersect select o_orderkey from orders where o_totalprice > 100000")
def id_set_intersection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return index.intersect(orders.where("o_custkey < 50"), orders.where("o_totalprice > 100000"), "o_orderkey")


# Codec.

DIGITS_SQL = "list_concat(list_transform(string_split(cast(abs({0}) as varchar), ''), lambda c: cast(c as integer) + case when {0} < 0 and c <> '0' then 16 else 0 end), [30])"


@entry(f"select c_custkey, array_to_string(list_transform({DIGITS_SQL.format('cast(round(c_acctbal * 100) as bigint)')}, lambda t: lpad(bin(t), 5, '0')), ' ') as bits from customer")
def encode_int_bits(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", codec.bits(codec.encode_integer(_cents("c_acctbal")), " ").alias("bits"))


@entry(f"select o_orderkey, cast(list_sum({DIGITS_SQL.format('o_orderkey')}) % 32 as integer) as checksum from orders")
def checksum(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", integrity.checksum(codec.encode_integer(F.col("o_orderkey"))).alias("checksum"))


@entry(
    f"""select o_orderkey, lower(array_to_string(list_transform(range(0, cast(length(b) / 4 as bigint)), lambda i: substr('0123456789abcdef', instr('0000 0001 0010 0011 0100 0101 0110 0111 1000 1001 1010 1011 1100 1101 1110 1111', substr(b, i * 4 + 1, 4))::bigint // 5 + 1, 1)), '')) as packed
    from (select o_orderkey, rpad(s, cast(ceil(length(s) / 8.0) * 8 as integer), '0') as b from (select o_orderkey, array_to_string(list_transform({DIGITS_SQL.format('o_orderkey')}, lambda t: lpad(bin(t), 5, '0')), '') as s from orders))"""
)
def pack_hex(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.pack_hex(codec.encode_integer(F.col("o_orderkey"))).alias("packed"))


@entry("select c_custkey, cast(round(c_acctbal * 100) as bigint) as cents from customer")
def unpack_roundtrip(spark, sf_dir):
    codes = codec.encode_integer(_cents("c_acctbal"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", codec.pack(codes).alias("b"), codec.pad_bits(codes).alias("pad"))
    return rows.select("c_custkey", parse.value_vector(parse.parsed(codec.unpack(F.col("b"), F.col("pad"))))[0].alias("cents"))


@entry("select n_nationkey, n_name as back from nation union all select cast(r_regionkey + 100 as integer) as n_nationkey, r_name as back from region")
def word_roundtrip(spark, sf_dir):
    both = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").union(table(spark, sf_dir, "region").selectExpr("cast(r_regionkey + 100 as int)", "r_name"))
    return both.select("n_nationkey", parse.text_of(parse.parsed(codec.encode_word(F.col("n_name")))).alias("back"))


@entry("select c_custkey, c_mktsegment as segment, cast(c_nationkey as varchar) as nation from customer")
def label_project(spark, sf_dir):
    label = lambda at, name: codec.encode_label(F.lit(at), F.lit(name))
    record = F.concat(label(0, "segment"), codec.encode_word(F.col("c_mktsegment")), label(1, "nation"), codec.encode_integer(F.col("c_nationkey")), F.array(F.lit(28)))
    return table(spark, sf_dir, "customer").select("c_custkey", parse.labelled(record).alias("m")).select("c_custkey", F.col("m")["segment"].alias("segment"), F.col("m")["nation"].alias("nation"))


@entry("select c_custkey, c_mktsegment as segment, cast(c_nationkey as varchar) as nation from customer")
def field_project(spark, sf_dir):
    record = codec.encode_record(F.col("c_mktsegment"), F.col("c_nationkey"), kinds=["word", "int"])
    return table(spark, sf_dir, "customer").select("c_custkey", parse.fields(parse.parsed(record), ["segment", "nation"]).alias("f")).select("c_custkey", "f.*")


@entry("select o_orderkey, idx, v from (select o_orderkey, unnest([0, 1]) as idx, unnest([o_orderkey, o_custkey])::bigint as v from orders)")
def split_records(spark, sf_dir):
    stream = F.concat(codec.encode_record(F.col("o_orderkey")), codec.encode_record(F.col("o_custkey")))
    ship(spark)
    rows = parse.records_of(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), stream.alias("tokens")))
    return rows.select(F.col("path").cast("bigint").alias("o_orderkey"), F.col("record_idx").cast("int").alias("idx"), parse.value_vector(parse.parsed("tokens"))[0].alias("v"))


@entry("select l_orderkey, l_linenumber, cast(floor((l_linenumber - 4) * 7 / 2.0) as bigint) + power(l_linenumber, 2)::bigint as v from lineitem")
def expr_eval(spark, sf_dir):
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arith.expression(["(", line, "-", 4, ")", "*", 7, "/", 2, "+", line, "^", 2]).alias("v"))


@entry("select s_suppkey, cast(s_suppkey * 3 - 7 as varchar) as v from supplier")
def expr_eval_streams(spark, sf_dir):
    codes = codec.encode_expression(F.col("s_suppkey"), "*", 3, "-", 7)
    return table(spark, sf_dir, "supplier").select("s_suppkey", parse.evaluated(codes).alias("v"))


@entry("select c_custkey, cast(cast(round(c_acctbal * 100) as bigint) * 10 + c_nationkey as bigint) as numerator, 3 as scale from customer")
def decimal_add(spark, sf_dir):
    out = arith.add(arith.scaled(_cents("c_acctbal"), F.lit(2)), arith.scaled(F.col("c_nationkey"), F.lit(3)))
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("d")).select("c_custkey", F.col("d.numerator").cast("bigint").alias("numerator"), "d.scale")


@entry("select c_custkey, cast(cast(round(c_acctbal * 100) as bigint) * c_nationkey as bigint) as numerator, 5 as scale from customer")
def decimal_mul(spark, sf_dir):
    out = arith.multiply(arith.scaled(_cents("c_acctbal"), F.lit(2)), arith.scaled(F.col("c_nationkey"), F.lit(3)))
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("d")).select("c_custkey", F.col("d.numerator").cast("bigint").alias("numerator"), "d.scale")


TWO_SUMS = "(select o_orderkey, list_sum(" + DIGITS_SQL.format("o_orderkey") + ") % 32 as a, list_sum(" + DIGITS_SQL.format("o_custkey") + ") % 32 as b from orders)"


@entry(f"select cast(o_orderkey as varchar) as path, unnest([0, 1]) as segment, cast(unnest([a, b]) as integer) as expected, true as passed from {TWO_SUMS}")
def checksum_scan(spark, sf_dir):
    ship(spark)
    two = F.concat(*[integrity.append_checksum(codec.encode_integer(F.col(c))) for c in ("o_orderkey", "o_custkey")])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), two.alias("tokens"))
    return parse.checksums_of(rows).select("path", "segment", "expected", "passed")


@entry("select n_nationkey, 0 as segment, cast(list_sum(d) % 32 as integer) as expected, true as passed from (select n_nationkey, " + DIGITS_SQL.format("n_nationkey") + " as d from nation)")
def checksum_scan_sql(spark, sf_dir):
    parse.register(spark)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", integrity.append_checksum(codec.encode_integer(F.col("n_nationkey"))).alias("t"))
    rows.createOrReplaceTempView("lodestone_streams")
    return spark.sql("select n_nationkey, s.segment, s.expected, s.passed from lodestone_streams, lateral scan_checksums(t) s")


@entry("select o_orderkey, length(cast(o_orderkey as varchar)) + 1 as at from orders")
def sync_point(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", integrity.next_sync_point(codec.encode_record(F.col("o_orderkey"))).cast("bigint").alias("at"))


@entry("select o_orderkey, false as passed from orders")
def bit_flip(spark, sf_dir):
    codes = codec.encode_record(F.col("o_orderkey"), F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", integrity.verify_checksum(integrity.flip_bit(codes, 0, 2), integrity.checksum(codes))["passed"].alias("passed"))


@entry("select o_orderkey, true as passed from orders")
def checksum_verify(spark, sf_dir):
    codes = codec.encode_record(F.col("o_orderkey"), F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", integrity.verify_checksum(codes, integrity.checksum(codes))["passed"].alias("passed"))


@entry("select o_orderkey // 10 as block, cast(sum(length(cast(o_orderkey as varchar)) + 2) + 2 as bigint) as n_tokens from orders group by 1")
def periodic_checksums(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_idx"), codec.encode_record(F.col("o_orderkey")).alias("tokens"))
    return integrity.periodic_checksums(rows, 10).select(F.col("block").cast("bigint").alias("block"), F.size("tokens").cast("bigint").alias("n_tokens"))


@entry("select l_orderkey, l_linenumber, cast(list_reduce(list_transform(range(l_linenumber * 5), lambda i: 3::hugeint), lambda a, b: a * b) as bigint) as v from lineitem")
def expr_pow_exact(spark, sf_dir):
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arith.expression([3, "^", "(", line, "*", 5, ")"]).alias("v"))


@entry("select o_orderkey, cast(1000000000000000000000::hugeint * (o_orderkey + 1) - o_custkey as varchar) as v from orders")
def expr_wide(spark, sf_dir):
    wide = arith.expression([10**21, "*", "(", F.col("o_orderkey"), "+", 1, ")", "-", F.col("o_custkey")])
    return table(spark, sf_dir, "orders").select("o_orderkey", wide.cast("string").alias("v"))


@entry("select s_suppkey, cast(s_suppkey + 70 * 3 as varchar) as v from supplier")
def scaled_eval(spark, sf_dir):
    codes = codec.encode_expression(F.col("s_suppkey"), "S", 2, "+", 70, "S", 1, "*", 3)
    return table(spark, sf_dir, "supplier").select("s_suppkey", parse.evaluated(codes).alias("v"))


@entry("select c_custkey, cast(trunc(c_acctbal * 100 + case when c_acctbal < 0 then -0.000001 else 0.000001 end) as bigint) / 100.0 as v from customer")
def decimal_from_double(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(arith.as_double(arith.from_double(F.round("c_acctbal", 2))), 2).alias("v"))


# Streams of several values.


@entry("select c_custkey, array_to_string(list_transform([c_nationkey % 10, case when c_nationkey % 10 = 0 then 0 else 16 + c_nationkey % 10 end, 30], lambda t: lpad(bin(t), 5, '0')), ' ') as bits from customer")
def encode_signed_digits(spark, sf_dir):
    digit = F.col("c_nationkey") % 10
    return table(spark, sf_dir, "customer").select("c_custkey", codec.bits(codec.encode_digits(F.array(digit, -digit)), " ").alias("bits"))


COMMAND_CODES = [31] * 4 + [0] + [30] * 4  # AUTH among the commands


@entry(f"select c_custkey, array_to_string(list_transform(list_concat({COMMAND_CODES}, list_concat({DIGITS_SQL.format('c_custkey')}, [30])), lambda t: lpad(bin(t), 5, '0')), '') as bits from customer")
def encode_command(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", codec.bits(codec.encode_command("AUTH", F.col("c_custkey"))).alias("bits"))


@entry("select p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: cast(ascii(c) as varchar)), ' ') as bytes from part")
def bytes_as_numbers(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parse.value_vector(parse.parsed(codec.encode_bytes(F.col("p_name").cast("binary")))).cast("array<string>"), " ").alias("bytes"))


@entry("select o_orderkey, cast(substr(cast(o_custkey as varchar), 1, 1) as integer) as first_code from orders")
def read_at_offset(spark, sf_dir):
    codes = codec.encode_record(F.col("o_orderkey"), F.col("o_custkey"))
    offset = 5 * (F.length(F.col("o_orderkey").cast("string")) + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.read_at(codes, offset, F.lit(1))[0].alias("first_code"))


@entry("select c_custkey, unnest([0, 1]) as pos, unnest(['number', 'word']) as kind, unnest([null, c_mktsegment]) as text, unnest([cast(c_nationkey as varchar), null]) as value from customer")
def chain_parse(spark, sf_dir):
    ship(spark)
    codes = F.concat(codec.encode_integer(F.col("c_nationkey")), codec.encode_word(F.col("c_mktsegment")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(parse.parsed(codes)).alias("pos", "p"))
    return rows.select("c_custkey", "pos", "p.kind", "p.text", F.col("p.value").cast("string").alias("value"))


@entry("select c_custkey, cast(c_nationkey as varchar) || c_mktsegment as text from customer")
def insert_kinds(spark, sf_dir):
    """Numbers, words and records are appended to a folder in one commit and read back."""
    ship(spark)
    path = shared_dir(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", codec.encode_record(F.col("c_nationkey"), F.col("c_mktsegment"), kinds=["int", "word"]).alias("tokens"))
    store.append(rows, path)
    return spark.read.parquet(path).select("c_custkey", parse.text_of(parse.parsed("tokens")).alias("text"))


# Policies and tenants.


@entry("select o_orderkey, o_custkey from orders where o_custkey = 13")
def owner_only(spark, sf_dir):
    rules = policy.Policies().add("orders", "read", policy.owner_only)
    return rules.view(table(spark, sf_dir, "orders"), "orders", "read", "o_custkey", 13).select("o_orderkey", "o_custkey")


@entry("select o_orderkey, o_custkey from orders")
def owner_or_admin(spark, sf_dir):
    rules = policy.Policies().add("*", "*", policy.owner_or_admin).add("orders", "read", policy.authenticated_only)
    return rules.view(table(spark, sf_dir, "orders"), "orders", "read", "o_custkey", policy.ADMIN).select("o_orderkey", "o_custkey")


@entry("select o_orderkey from orders where o_custkey = 13 or o_custkey is null")
def owner_vector(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_custkey"), F.col("o_orderkey")).alias("vec"))
    return policy.owned(rows, "vec", 13).select("o_orderkey")


GRANTS = """with s as (select user_id as record_id, arg_max(event_type, event_id) filter (event_type in ('click', 'error')) as g from events group by 1)"""


@entry(GRANTS + " select o.record_id from (select distinct user_id as record_id from events) o left join s using (record_id) where coalesce(s.g = 'click', false) or o.record_id = 5")
def grants(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    records = events.selectExpr("user_id as record_id").distinct()
    owners = records.selectExpr("record_id", "-1L as pos", "'AUTH' as cmd", "record_id as arg")
    given = events.where("event_type in ('click', 'error')").selectExpr("user_id as record_id", "event_id as pos", "if(event_type = 'click', 'GRANT_R', 'REVOKE') as cmd", "5L as arg")
    return policy.readable(records, owners.union(given), 5)


@entry("select c_custkey from customer where c_nationkey = 4 order by c_custkey limit 1000")
def tenant_scope(spark, sf_dir):
    return policy.tenant(table(spark, sf_dir, "customer").withColumn("tenant", F.col("c_nationkey").cast("string")), "4", most=1000, key="c_custkey").select("c_custkey")


@entry("select c_custkey from customer where c_name not in (select c_name from customer where c_custkey % 2 = 0)")
def new_accounts(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return policy.without_duplicates(customer, customer.where("c_custkey % 2 = 0"), "c_name").select("c_custkey")


@entry("select o_orderkey, o_orderpriority from orders")
def encrypt_roundtrip(spark, sf_dir):
    from ..operators import crypto

    ship(spark)
    orders = table(spark, sf_dir, "orders")
    sealed = orders.select("o_orderkey", crypto.encrypt_for_user(F.col("o_orderpriority").cast("binary"), F.col("o_orderkey"), 7, b"secret").alias("c"))
    return sealed.select("o_orderkey", crypto.decrypt_for_user(F.col("c"), F.col("o_orderkey"), 7, b"secret").cast("string").alias("o_orderpriority"))


@entry("select o_orderkey, o_orderpriority from orders where o_orderkey % 3 = 0")
def server_grants(spark, sf_dir):
    from ..operators import crypto

    ship(spark)
    key, server = crypto.password_key(b"salt", "pw"), bytes(32)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.lit(7).alias("user_id"), "o_orderpriority")
    sealed = orders.select("record_id", "user_id", crypto.encrypt_with_password(F.col("o_orderpriority").cast("binary"), F.col("record_id"), b"salt", "pw").alias("content"))
    escrow = spark.createDataFrame([(7, crypto.escrow_key(key, server))], "user_id int, escrowed binary")
    found = crypto.read_as_server(sealed, orders.where("record_id % 3 = 0"), escrow, server)
    return found.select(F.col("record_id").alias("o_orderkey"), F.col("content").cast("string").alias("o_orderpriority"))


@entry("select o_orderkey, o_orderpriority from orders")
def two_modes(spark, sf_dir):
    from ..operators import crypto

    ship(spark)
    orders = table(spark, sf_dir, "orders").withColumn("mode", F.expr("if(o_orderkey % 2 = 0, 'zero', 'managed')"))
    plain, key = F.col("o_orderpriority").cast("binary"), F.col("o_orderkey")
    sealed = F.when(F.col("mode") == "zero", crypto.encrypt_with_password(plain, key, b"s", "pw")).otherwise(crypto.encrypt_for_user(plain, key, 7, b"app"))
    opened = crypto.open_by_mode(F.col("mode"), F.col("c"), key, 7, b"s", "pw", b"app")
    return orders.withColumn("c", sealed).select("o_orderkey", opened.cast("string").alias("o_orderpriority"))


@entry("select event_id as seq, user_id as record_id, true as intact, cast(round(value * 100) as bigint) as v from events")
def wal_roundtrip(spark, sf_dir):
    """Write-ahead logs in the binary layout: written, read back and checked entry by entry."""
    from ..sources import binary

    ship(spark)
    path = shared_dir(spark)
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("record_id"), codec.encode_record(_cents("value")).alias("tokens"))
    binary.write_log(log, path, each=500)
    back = binary.log_rows(spark.read.parquet(path).select(F.col("part").cast("string").alias("path"), "content"))
    return back.select("seq", "record_id", "intact", parse.value_vector(parse.parsed("tokens"))[0].alias("v"))


@entry("select url as path, sha256(html) as sha256 from pages where page_id = 7")
def object_download(spark, sf_dir):
    name = table(spark, sf_dir, "pages").where("page_id = 7").first()["url"]
    return objects.download(_objects(spark, sf_dir), "b", name, user=1).select("path", F.sha2("content", 256).alias("sha256"))


# Checked writes, fluent writes, transactions, memory.


@entry("select o_orderkey as record_id, case when o_orderkey % 2 = 0 then 'write' else 'create' end as action, o_orderkey % 2 = 1 or o_custkey = 13 as permitted from orders")
def policy_writes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_custkey")
    rules = policy.Policies().add("orders", "write", policy.owner_only).add("orders", "create", policy.authenticated_only)
    return rules.writes(orders.where("record_id % 2 = 0"), orders.select("record_id"), "orders", "o_custkey", 13)


@entry("select o_orderkey as record_id, o_orderkey % 2 = 1 or o_custkey = 13 as accepted, cast(13 as bigint) as owner, o_custkey as v from orders")
def owner_writes(spark, sf_dir):
    ship(spark)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.array("o_custkey").alias("vec"), codec.encode_record(F.col("o_custkey")).alias("tokens"))
    done = policy.write_as(orders.where("record_id % 2 = 0"), orders.select("record_id", "tokens"), 13)
    values = parse.value_vector(parse.parsed("tokens"))
    return done.select("record_id", "accepted", values.alias("v")).select("record_id", "accepted", F.col("v")[0].alias("owner"), F.col("v")[1].alias("v"))


@entry("select o_orderkey as record_id, o_custkey = 13 as accepted from orders")
def owner_deletes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.array("o_custkey").alias("vec"))
    return policy.delete_as(orders, orders.select("record_id"), 13)


@entry("select o_orderkey from orders")
def admin_bypass(spark, sf_dir):
    rules = policy.Policies().add("orders", "read", policy.owner_only)
    return rules.view(table(spark, sf_dir, "orders"), "orders", "read", "o_custkey", 13, bypass=True).select("o_orderkey")


@entry("select c_custkey, case when c_custkey = 4 then 'CHANGED' else c_name end as c_name from customer where c_custkey <> 5 union all select -1 as c_custkey, 'NEW' as c_name")
def fluent_writes(spark, sf_dir):
    customer = query.Table(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    new = spark.createDataFrame([(-1, "NEW"), (7, "there already")], "c_custkey bigint, c_name string")
    right = customer.get(4).select(customer.hash().alias("h")).first()["h"]
    changed = customer.insert(new).update(4, if_match=right, c_name="CHANGED").update(6, if_match="stale", c_name="LOST")
    return changed.delete(5).rows()


@entry(
    """with t as (select o_orderkey as record_id, o_custkey as v from orders),
    s as (select record_id, 0 as v from t where record_id % 10 = 1 union all select record_id + 1 as record_id, 1 as v from t where record_id % 10 = 1)
    select record_id, cast(v as bigint) as v from s union all select record_id, v from t where record_id % 7 <> 0 and record_id not in (select record_id from s)"""
)
def txn_store(spark, sf_dir):
    """One transaction writes, one deletes and swaps, one is rolled back and one is never ended."""
    from ..operators.transactions import TransactionalStore

    ship(spark)
    held = TransactionalStore(spark, shared_dir(spark))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), codec.encode_record(F.col("o_custkey")).alias("tokens"))
    held.begin().put(rows).commit()
    pairs = rows.where("record_id % 10 = 1").select(F.col("record_id").alias("from_id"), (F.col("record_id") + 1).alias("to_id"), codec.encode_record(F.lit(0)).alias("from_tokens"), codec.encode_record(F.lit(1)).alias("to_tokens"))
    held.begin().delete(rows.where("record_id % 7 = 0")).swap(pairs).commit()
    nines = rows.withColumn("tokens", codec.encode_record(F.lit(9)))
    held.begin().put(nines).rollback()
    held.begin().put(nines)
    return held.state().select("record_id", parse.value_vector(parse.parsed("tokens"))[0].alias("v"))


@entry(f"select record_id, cast(case when record_id % 2 = 0 then 0 else cents end as bigint) as cents from {LATEST} where not is_deleted")
def cached_reads(spark, sf_dir):
    """The live rows are held in memory; a write drops them, and the next read sees it."""
    held = store.Cached(_versions(spark, sf_dir))
    held.live().count()
    even = held.live().where("record_id % 2 = 0").selectExpr("record_id", "9000000000L as version", "'reset' as event_type", "0L as cents")
    held.write(even)
    return held.live().select("record_id", "cents")


@entry("select o_orderkey, o_custkey from orders where o_orderkey % 2 = 0 union all select o_orderkey, o_custkey from orders where o_orderkey % 2 = 1")
def union_partitions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey as record_id", "o_custkey", "1L as version", "false as is_deleted")
    return store.live(store.upsert(orders.where("record_id % 2 = 0"), orders.where("record_id % 2 = 1"))).selectExpr("record_id as o_orderkey", "o_custkey")


@entry("select o_custkey, o_orderkey from orders where o_custkey = 20")
def btree_get(spark, sf_dir):
    return index.get(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 20)


@entry("select o_custkey, o_orderkey from orders where o_custkey >= 20 and o_custkey < 35 and o_orderkey % 2 = 0")
def btree_soft_delete(spark, sf_dir):
    entries = table(spark, sf_dir, "orders").selectExpr("o_custkey", "if(o_orderkey % 2 = 0, o_orderkey, -1) as o_orderkey")
    return index.range_scan(entries, "o_custkey", "o_orderkey", 20, 35)


@entry("select c_custkey, c_name, o_orderkey from customer join orders on c_custkey = o_custkey order by c_custkey")
def merge_join_ordered(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.merge_join(customer, orders, "c_custkey", "o_custkey", ordered=True).select("left.c_custkey", "left.c_name", "right.o_orderkey")


@entry("select n_name from nation where n_nationkey = 4 union all select 'NEW' as n_name")
def signup_login(spark, sf_dir):
    from ..operators import accounts

    ship(spark)
    users = spark.createDataFrame([], "user_id bigint, email string, salt string, hash string, name string")
    nation = table(spark, sf_dir, "nation").select(F.concat("n_nationkey", F.lit("@x")).alias("email"), F.lit("pw").alias("password"), F.col("n_name").alias("name"), F.lit("s").alias("salt"))
    users = accounts.signup(users, nation)
    users = accounts.signup(users, spark.createDataFrame([("4@x", "other", "IGNORED", "s"), ("new@x", "pw", "NEW", "s")], "email string, password string, name string, salt string"))
    return accounts.login(users, "4@x", "pw").union(accounts.login(users, "new@x", "pw")).union(accounts.login(users, "3@x", "wrong")).select(F.col("name").alias("n_name"))


@entry("select event_id, event_type || cast(user_id as varchar) || coalesce(cast(cast(props::json->>'k' as bigint) as varchar), '') as text from events")
def json_records(spark, sf_dir):
    """A word, a number, a number of a nested text, and a field that is not there."""
    ship(spark)
    events = table(spark, sf_dir, "events")
    body = F.to_json(F.struct("event_type", "user_id", F.get_json_object("props", "$.k").alias("k")))
    codes = store.json_codes(body, [("event_type", "word"), ("user_id", "int"), ("k", "int"), ("missing", "word")])
    return events.select("event_id", parse.text_of(parse.parsed(codes)).alias("text"))


@entry(
    """with t as (select c_custkey as record_id, c_mktsegment || cast(c_nationkey as varchar) as text from customer where c_custkey % 2 = 0)
    select case when record_id % 3 = 0 then 'NEW' || cast(record_id as varchar) else text end as text from t where record_id % 5 <> 0
    union all select c_mktsegment || cast(c_nationkey as varchar) as text from customer where c_custkey % 2 = 1"""
)
def json_writes(spark, sf_dir):
    """JSON texts are created with their own ids and with free ones, some are updated if they match, some deleted."""
    ship(spark)
    fields = [("name", "word"), ("n", "int")]
    customer = table(spark, sf_dir, "customer")
    text = F.to_json(F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("_id"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("n")))
    none = spark.createDataFrame([], "record_id bigint, version bigint, is_deleted boolean, tokens array<int>")
    held = store.create_json(none, customer.select(text.alias("body")), fields, 1)
    even = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("record_id"))
    own = store.live(held).select("record_id", integrity.content_hash(F.col("tokens")).alias("h"))
    body = F.to_json(F.struct(F.lit("NEW").alias("name"), F.col("record_id").alias("n")))
    writes = even.join(own, "record_id").select("record_id", body.alias("body"), F.when(F.col("record_id") % 3 == 0, F.col("h")).otherwise("stale").alias("if_match"))
    held = store.update_json(held, writes, fields, 2)
    held = store.delete(held, even.where("record_id % 5 = 0"), 3)
    return store.live(held).select(parse.text_of(parse.parsed("tokens")).alias("text"))


@entry("select s_suppkey, cast(s_suppkey * 10 + 7 as bigint) as numerator, 3 as scale from supplier")
def scaled_columns(spark, sf_dir):
    """The numbers of streams with their scales, added as decimals."""
    ship(spark)
    codes = codec.encode_expression(F.col("s_suppkey"), "S", 2, "+", 7, "S", 3)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", parse.scaled_values(codes).alias("v"))
    return rows.select("s_suppkey", arith.add(F.col("v")[0], F.col("v")[1]).alias("d")).select("s_suppkey", F.col("d.numerator").cast("bigint").alias("numerator"), "d.scale")


def _labels(spark, sf_dir) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.select("c_custkey", F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string")).alias("labels"))


@entry("select c_custkey as record_id from customer where c_mktsegment = 'BUILDING' and c_custkey <> 8 union all select c_custkey as record_id from customer where c_nationkey >= 3 and c_nationkey < 9 order by 1")
def auto_index(spark, sf_dir):
    """All labelled fields are indexed; a later version of a record replaces its entries."""
    path, rows = shared_dir(spark), _labels(spark, sf_dir)
    index.index_labels(rows.withColumn("version", F.lit(1)), "c_custkey", "labels", path)
    moved = rows.where("c_custkey = 8").select("c_custkey", F.create_map(F.lit("segment"), F.lit("MOVED")).alias("labels"), F.lit(2).alias("version"))
    index.index_labels(moved, "c_custkey", "labels", path)
    return index.lookup(spark, path, "segment", "BUILDING").union(index.between(spark, path, "nation", 3, 9).select("record_id"))


@entry("select 'nation' as field, 'BIGINT' as kind union all select 'segment' as field, 'STRING' as kind")
def inferred_fields(spark, sf_dir):
    return spark.createDataFrame(index.infer_fields(_labels(spark, sf_dir), "labels"), "field string, kind string")


@entry("select o_orderkey, o_orderkey % 2 = 0 as accepted from orders")
def update_if_match(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.lit(1).alias("version"), F.lit(False).alias("is_deleted"), codec.encode_record(F.col("o_orderkey")).alias("tokens"))
    own = integrity.content_hash(F.col("tokens"))
    writes = orders.select("record_id", F.when(F.col("record_id") % 2 == 0, own).otherwise(F.lit("stale")).alias("if_match"))
    return store.update_if_match(orders, writes).select(F.col("record_id").alias("o_orderkey"), "accepted")


@entry("select o_orderkey, o_orderpriority as priority from orders")
def grid_roundtrip(spark, sf_dir):
    from ..sources import binary

    ship(spark)
    path = shared_dir(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_idx"), codec.encode_record(F.col("o_orderkey"), F.col("o_orderpriority"), kinds=["int", "word"]).alias("tokens"))
    binary.write_grid(rows, path)
    back = binary.grid_rows(spark.read.parquet(path).select(F.col("part").cast("string").alias("path"), "content")).select(parse.parsed("tokens").alias("p"))
    return back.select(F.col("p")[0]["value"].cast("bigint").alias("o_orderkey"), parse.text_of(F.slice("p", 2, 100)).alias("priority"))


@entry("select o_orderkey as record_id, case when o_orderkey % 5 = 0 then 2 else 1 end as flag, case when o_orderkey % 5 = 0 then 0 else o_custkey + 1 end as v from orders")
def positioned_roundtrip(spark, sf_dir):
    """Fixed-stride files: written, some slots deleted by a later version, read back."""
    from ..sources import binary

    ship(spark)
    path = shared_dir(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.lit(1).alias("version"), codec.encode_record(F.col("o_custkey") + 1).alias("tokens"))
    gone = rows.where("record_id % 5 = 0").select("record_id", F.lit(2).alias("version"), F.array(*[F.lit(c) for c in binary.DELETED]).alias("tokens"))
    binary.write_positioned(rows.unionByName(gone), path, stride_bits=128)
    back = binary.positioned_rows(spark.read.parquet(path).withColumn("path", F.col("part").cast("string")))
    return back.select("record_id", "flag", parse.value_vector(parse.parsed("tokens"))[0].alias("v"))


@entry("select translate(cast(page_id as varchar), '0123456789', 'abcdefghij') || '.html' as name, cast(strlen(html) as bigint) as size, sha256(html) as sha256 from pages")
def archive_roundtrip(spark, sf_dir):
    from ..sources import binary

    ship(spark)
    path = shared_dir(spark)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), F.concat(F.translate(F.col("page_id").cast("string"), "0123456789", "abcdefghij"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content"))
    binary.write_archives(pages, path, each=16)
    back = binary.archive_rows(spark.read.parquet(path).select(F.col("part").cast("string").alias("path"), "content"))
    return back.select("name", "size", F.sha2("content", 256).alias("sha256"))


# Change feeds and objects.


@entry("select event_id, event_type from events where event_id > 500 and event_type in ('error', 'signup') order by event_id")
def changes_since(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr("event_id as seq", "user_id as record_id", "event_type as type")
    return store.since(log, 500, types=["error", "signup"]).selectExpr("seq as event_id", "type as event_type")


@entry("select event_id, case when event_type = 'purchase' then 'TXN_COMMIT' when event_type = 'view' then 'PUT' else 'UNKNOWN' end as type from events")
def change_types(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 1).otherwise(3).alias("flag"))
    return feeds.typed(log).select("event_id", "type")


@entry("select event_id from events where event_type = 'click' and user_id <> 5")
def channel_messages(spark, sf_dir):
    return feeds.channel(table(spark, sf_dir, "events").selectExpr("event_id", "event_type as channel", "user_id as sender"), "click", 5).select("event_id")


@entry("select user_id, max(ts) as last_seen from events group by user_id having max(ts) >= (select max(ts) from events) - interval 3600 seconds")
def presence_ttl(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("t")).first()["t"]
    return feeds.presence(events, "user_id", "ts", F.lit(now).cast("timestamp_ntz"), 3600)


@entry("select user_id, max(ts) as last_seen, arg_max(event_type, ts) as channel from events group by user_id having max(ts) >= (select max(ts) from events) - interval 36000 seconds and arg_max(event_type, ts) = 'click'")
def presence_channel(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("t")).first()["t"]
    return feeds.presence(events, "user_id", "ts", F.lit(now).cast("timestamp_ntz"), 36000, channel="event_type", name="click")


@entry("select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 60 seconds preceding and current row) as n_recent from events")
def window_count(spark, sf_dir):
    return feeds.recent_count(table(spark, sf_dir, "events"), "user_id", "ts", 60).select("event_id", "user_id", "n_recent")


RATE_SQL = """
with recursive o as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn from events),
r as (
    select user_id, rn, event_id, true as allowed, [us] as held from o where rn = 1
    union all
    select o.user_id, o.rn, o.event_id, len(list_filter(r.held, lambda h: h > o.us - 3600000000)) < 3 as allowed,
        case when len(list_filter(r.held, lambda h: h > o.us - 3600000000)) < 3 then list_append(list_filter(r.held, lambda h: h > o.us - 3600000000), o.us) else list_filter(r.held, lambda h: h > o.us - 3600000000) end as held
    from r join o on o.user_id = r.user_id and o.rn = r.rn + 1
)
select event_id, cast(user_id as varchar) as key, allowed from r
"""


@entry(RATE_SQL)
def rate_limit(spark, sf_dir):
    ship(spark)
    return feeds.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 3600.0)


@entry()
def rate_limit_dual(spark, sf_dir):
    """The address's limit, then the user's; the address is the event's hour, which several users share."""
    ship(spark)
    events = table(spark, sf_dir, "events").withColumn("address", F.date_format("ts", "yyyy-MM-dd HH"))
    return feeds.rate_limit_dual(events, "address", "user_id", "ts", "event_id", ip_most=8, user_most=3, seconds=3600.0)


@entry("select event_id, user_id from events where event_id < 700")
def replicate_halt(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    content = F.concat_ws("|", "event_id", "user_id")
    log = events.withColumn("sha256", F.when(F.col("event_id") == 700, "0").otherwise(F.sha2(content, 256)))
    return feeds.replicate(log, content, "event_id").select("event_id", "user_id")


@entry("select event_id, user_id, event_type from events where event_type = 'purchase'")
def stream_changes(spark, sf_dir):
    """Runs the stream to the end of the folder and reads what its sink wrote."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path if _is_folder(spark, path) else f"{sf_dir}/events.parq[u]et")
    out = feeds.subscribe(events.withColumnRenamed("event_type", "type"), types=["purchase"]).selectExpr("event_id", "user_id", "type as event_type")
    sink, place = shared_dir(spark), shared_dir(spark)
    out.writeStream.format("parquet").option("checkpointLocation", place).trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


@entry("select event_id, user_id from events where event_id > 500")
def follow_changes(spark, sf_dir):
    """A subscriber that knows event 500: history and live by one stream, run to the end of the folder."""
    folder, sink, place = (shared_dir(spark) for _ in range(3))
    log = table(spark, sf_dir, "events").select("event_id", "user_id")
    log.where("event_id % 2 = 0").write.parquet(folder)
    log.where("event_id % 2 = 1").write.mode("append").parquet(folder)
    live = feeds.follow(spark, folder, log.schema, 500, "event_id")
    live.writeStream.format("parquet").option("checkpointLocation", place).trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.schema(log.schema).parquet(sink)


@entry("select event_id, h.hook from events e join (values ('a', 'error'), ('b', '*')) h(hook, type) on h.type = '*' or h.type = e.event_type")
def webhook_matches(spark, sf_dir):
    hooks = spark.createDataFrame([("a", "events", "error"), ("b", "events", "*"), ("c", "other", "*")], "hook string, hook_table string, hook_type string")
    events = table(spark, sf_dir, "events").select("event_id", F.lit("events").alias("table_name"), F.col("event_type").alias("type"))
    return feeds.webhook_matches(events, hooks).select("event_id", "hook")


@entry("select event_id from events where event_type = 'error'")
def dead_letters(spark, sf_dir):
    """Errors are never delivered; the others are, some at the second try."""
    ship(spark)
    seen = set()

    def send(row: dict) -> bool:
        again = row["event_id"] in seen
        seen.add(row["event_id"])
        return row["event_type"] != "error" and (again or row["event_id"] % 2 == 0)

    return feeds.deliver(table(spark, sf_dir, "events").select("event_id", "event_type"), send, lambda seconds: None).select("event_id")


@entry("select event_id from events where ts > (select max(ts) from events) - interval 86400 seconds")
def live_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("t")).first()["t"]
    rows = events.select("event_id", (F.col("ts") + F.expr("interval 86400 seconds")).alias("expires_at"))
    return feeds.sessions(rows, "expires_at", F.lit(now).cast("timestamp_ntz")).select("event_id")


@entry("select event_id, user_id from events")
def group_commit(spark, sf_dir):
    """Micro-batches of a stream are each handed over and written once."""
    folder, sink, place = (shared_dir(spark) for _ in range(3))
    log = table(spark, sf_dir, "events").select("event_id", "user_id")
    log.write.parquet(folder)
    feeds.commit_batches(feeds.tail(spark, folder, log.schema), lambda df, n: df.write.mode("append").parquet(sink), place).awaitTermination()
    return spark.read.schema(log.schema).parquet(sink)


def _is_folder(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


@entry("select 'b' as bucket, url as path, cast(strlen(html) as bigint) as size, sha256(html) as sha256, cast(1 as bigint) as owner from pages where starts_with(url, 'https') order by url limit 100")
def object_list(spark, sf_dir):
    return objects.listing(_objects(spark, sf_dir), "b", "https", 100)


def _objects(spark, sf_dir) -> DataFrame:
    return objects.objects(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content")), "b", 1)


@entry("select url as path, case when page_id % 3 = 0 then sha256('new') else sha256(html) end as sha256, cast(case when page_id % 3 = 0 then 2 else 1 end as bigint) as owner from pages where page_id <> 5")
def object_writes(spark, sf_dir):
    """Uploads replace objects of the same path; one object is removed."""
    pages = table(spark, sf_dir, "pages")
    new = objects.objects(pages.where("page_id % 3 = 0").select(F.col("url").alias("path"), F.lit("new").cast("binary").alias("content")), "b", 2)
    gone = pages.where("page_id = 5").first()["url"]
    return objects.remove(objects.upload(_objects(spark, sf_dir), new), "b", gone).select("path", "sha256", "owner")


@entry("select sha256(html) as sha256, count(*) as n from pages group by 1")
def object_dedup(spark, sf_dir):
    return _objects(spark, sf_dir).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))


@entry("select n_regionkey from nation where n_nationkey = 12")
def attribute_lookup(spark, sf_dir):
    return query.Table(table(spark, sf_dir, "nation"), "n_nationkey").get(12).select("n_regionkey")


# What SQL gives beyond: grouping, windows, sets, outer joins.


@entry("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, avg(l_discount) as avg_disc, count(*) as n from lineitem group by l_returnflag, l_linestatus")
def group_by(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@entry("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders")
def window_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"))


@entry("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@entry("select c_nationkey as k from customer except select s_nationkey as k from supplier where s_nationkey < 12")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_nationkey as k").subtract(table(spark, sf_dir, "supplier").where("s_nationkey < 12").selectExpr("s_nationkey as k"))
