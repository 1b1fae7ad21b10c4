"""Change feeds, channels, presence, rate limits, sessions, webhooks and replication on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import components
from ..session import materialize

BACKOFF = (1, 2, 4, 8, 16)


def tail(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New files of a change-log folder as a stream; the position is in the query's checkpoint."""
    return spark.readStream.schema(schema).parquet(folder)


def typed(log: DataFrame, flag: str = "flag") -> DataFrame:
    """log with ``type``: TXN_COMMIT for commit markers (2), PUT for pending writes (1), else UNKNOWN."""
    return log.withColumn("type", F.when(F.col(flag) == 2, "TXN_COMMIT").when(F.col(flag) == 1, "PUT").otherwise("UNKNOWN"))


def subscribe(events: DataFrame, table: str | None = None, types: list[str] | None = None, record_id: int | None = None) -> DataFrame:
    """Events of a table, of some types, of one record; works on streams and tables."""
    if table is not None:
        events = events.where(F.col("table_name") == table)
    if types is not None:
        events = events.where(F.col("type").isin(*types))
    return events if record_id is None else events.where(F.col("record_id") == record_id)


def channel(messages: DataFrame, name: str, me: int) -> DataFrame:
    """Messages of a channel, without one's own."""
    return messages.where((F.col("channel") == name) & (F.col("sender") != me))


def presence(beats: DataFrame, user: str, ts: str, now: Column, ttl_seconds: int = 30, channel: str | None = None, name: str | None = None) -> DataFrame:
    """Users whose last heartbeat is at most ttl old; with ``channel`` and ``name``, those whose last heartbeat was in that channel."""
    last = beats.groupBy(user).agg(F.max(ts).alias("last_seen"), *([F.max_by(channel, ts).alias("channel")] if channel else []))
    fresh = last.where(F.col("last_seen") >= now - F.expr(f"interval {ttl_seconds} seconds"))
    return fresh if name is None else fresh.where(F.col("channel") == name)


def live_presence(beats: DataFrame, user: str, ts: str, ttl_seconds: int = 30) -> DataFrame:
    """(user, event, last_seen) with ``join`` at a user's first beat and ``leave`` after a silence of ttl, as a stream with state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"user": [str(key[0])], "event": ["leave"], "last_seen": [pd.Timestamp(last, unit="ms")]})
            return
        new = not state.exists
        last = max(int(pdf[ts].max().timestamp() * 1000) for pdf in batches)
        last = last if new else max(last, state.get[0])
        state.update((last,))
        state.setTimeoutTimestamp(last + ttl_seconds * 1000 + 1)
        if new:
            yield pd.DataFrame({"user": [str(key[0])], "event": ["join"], "last_seen": [pd.Timestamp(last, unit="ms")]})

    return beats.withWatermark(ts, "0 seconds").groupBy(user).applyInPandasWithState(step, "user string, event string, last_seen timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def admit(times: list[float], held: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which of some ascending times a sliding-window limit admits, and what it holds afterwards. Refused ones do not count."""
    out, held = [], list(held)
    for t in times:
        held = [h for h in held if h > t - seconds]
        ok = len(held) < most
        out.append(ok)
        if ok:
            held.append(t)
    return out, held


def wait(now: float, held: list[float], seconds: float) -> int:
    """Whole seconds until the oldest held time leaves the window."""
    return max(0, int(seconds - (now - held[0]))) if held else 0


def _walk(events: DataFrame, by: str, step: Callable, schema: str) -> DataFrame:
    """step(held, rows) for the rows of each value of ``by``, in time order, in streams of Arrow batches: no value is gathered whole."""
    parts = events.repartition(by).sortWithinPartitions(by, "us", "event_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, {}
        for pdf in batches:
            out = []
            for _, group in pdf.groupby((pdf[by] != pdf[by].shift()).cumsum(), sort=False):
                name = group[by].iloc[0]
                if name != last:
                    last, held = name, {}
                out.append(step(held, group))
            if out:
                yield pd.concat(out)

    return parts.mapInPandas(walk, schema)


def rate_limit(events: DataFrame, key: str, ts: str, event_id: str, most: int, seconds: float, retry: bool = False) -> DataFrame:
    """(event_id, key, allowed) by at most ``most`` admitted events of a key in ``seconds``, in time order; refused events don't count.

    The rule feeds back, so a key's events are walked in order; the state is ``most`` times. retry: also
    retry_after, the seconds until a refused key has a place again (0 if allowed).
    """
    plain = events.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("bigint").alias("event_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))

    def step(held: dict, group: pd.DataFrame) -> pd.DataFrame:
        allowed, after = [], []
        for t in (group["us"] / 1e6).tolist():
            (ok,), held[0] = admit([t], held.get(0, []), most, seconds)
            allowed.append(ok)
            after.append(0 if ok else wait(t, held[0], seconds))
        out = pd.DataFrame({"event_id": group["event_id"], "key": group["key"], "allowed": allowed})
        return out.assign(retry_after=after) if retry else out

    return _walk(plain, "key", step, "event_id bigint, key string, allowed boolean" + ", retry_after int" * retry)


def rate_limit_dual(events: DataFrame, ip: str, user: str, ts: str, event_id: str, ip_most: int = 100, user_most: int = 1000, seconds: float = 60.0) -> DataFrame:
    """(event_id, allowed, retry_after) by two limits: of the address, then of the user, if there is one. An event that the user's limit
    refuses takes no place of its address.

    Addresses and users that share events depend on each other, so the events of a connected component of both are
    walked together, in time order. The state is the held times of the component's addresses and users.
    """
    plain = events.select(F.col(ip).cast("string").alias("ip"), F.col(user).cast("string").alias("user"), F.col(event_id).cast("bigint").alias("event_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    plain = plain.withColumns({"u": F.xxhash64(F.lit("address"), "ip"), "v": F.xxhash64(F.lit("user"), "user")})
    roots = components(plain.where("user is not null").select("u", "v"))
    placed = plain.join(roots, F.col("u") == F.col("node"), "left").withColumn("part", F.coalesce("root", "u"))

    def step(held: dict, group: pd.DataFrame) -> pd.DataFrame:
        allowed, after = [], []
        for address, name, us in zip(group["ip"], group["user"], group["us"], strict=True):
            t, a, u = us / 1e6, ("ip", address), ("user", name)
            before = held.get(a, [])
            (ok,), held[a] = admit([t], before, ip_most, seconds)
            late = 0 if ok else wait(t, held[a], seconds)
            if ok and name is not None:
                (ok,), held[u] = admit([t], held.get(u, []), user_most, seconds)
                if not ok:
                    held[a] = held[a][:-1]
                    late = wait(t, held[u], seconds)
            allowed.append(ok)
            after.append(late)
        return pd.DataFrame({"event_id": group["event_id"], "allowed": allowed, "retry_after": after})

    return _walk(placed.select("part", "ip", "user", "event_id", "us"), "part", step, "event_id bigint, allowed boolean, retry_after int")


def live_rate_limit(events: DataFrame, key: str, ts: str, event_id: str, most: int, seconds: float) -> DataFrame:
    """rate_limit() as a stream: the held times are the state of each key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values([ts, event_id])  # a trigger's events of one key; maxFilesPerTrigger bounds them
        ok, held = admit([t.timestamp() for t in pdf[ts]], held, most, seconds)
        state.update((held,))
        yield pd.DataFrame({"event_id": pdf[event_id].astype("int64"), "key": str(k[0]), "allowed": ok})

    return events.groupBy(key).applyInPandasWithState(step, "event_id bigint, key string, allowed boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def recent_count(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """events with ``n_recent``: the key's events of the last seconds, its own included."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n_recent", F.count(F.lit(1)).over(w))


def sessions(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    """Sessions that have not expired."""
    return rows.where(F.col(expires) > now)


def webhook_matches(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Each event with the hooks registered for its table and type (``*`` for any)."""
    return events.join(hooks, (events["table_name"] == hooks["hook_table"]) & ((events["type"] == hooks["hook_type"]) | (hooks["hook_type"] == "*")))


def deliver(batch: DataFrame, send: Callable[[dict], bool], pause: Callable[[float], None]) -> DataFrame:
    """For foreachBatch: every row is sent, up to five times more after growing pauses. Returns the dead letters."""
    schema = batch.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dead = []
            for row in pdf.to_dict("records"):
                done = send(row)
                for wait in BACKOFF:
                    if done:
                        break
                    pause(wait)
                    done = send(row)
                dead.append(not done)
            yield pdf[dead]

    return materialize(batch.mapInPandas(run, schema))  # once: reading the result again must not send again


def replicate(log: DataFrame, content: Column, seq: str = "seq") -> DataFrame:
    """Entries before the first whose content does not have its hash."""
    from ..operators.store import before_damage

    return before_damage(log.withColumn("intact", F.sha2(content, 256) == F.col("sha256")), seq).drop("intact")


def commit_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], place: str, seconds: float | None = None):
    """Starts a query that hands every micro-batch to ``apply`` once: group commit, change callbacks, sinks. Without ``seconds`` it ends with the input."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", place)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def history_then_live(log: DataFrame, live: DataFrame, after: int, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """What a subscriber that knows ``after`` gets: the entries since, and the stream of later ones."""
    return log.where(F.col(seq) > after).orderBy(seq), live.where(F.col(seq) > after)


def follow(spark: SparkSession, folder: str, schema, after: int, seq: str = "seq", files: int | None = None) -> DataFrame:
    """All entries after a sequence number as one stream: what the folder holds, then what comes, each file once.

    One source reads both, so nothing falls between history and live. files: files in a micro-batch.
    """
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", str(files)) if files else reader
    return reader.parquet(folder).where(F.col(seq) > after)
