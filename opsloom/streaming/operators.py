"""Operators on streams: keyed publish, windows, routing, device state, queues; alarms are in ``alarms``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators.privacy import hash_number
from opsloom.plans.predicates import all_matches, first_match
from opsloom.plans.storage import cut_lineage
from opsloom.plans.timing import step_of


def put_messages(df: DataFrame, key: str, value: str, partitions: int, max_bytes: int = 1024 * 1024) -> DataFrame:
    """Partition per message from its key, and a result per entry with an error for what cannot be stored."""
    size = F.octet_length(F.col(value))
    error = F.when(F.col(value).isNull(), "EMPTY_VALUE").when(size > max_bytes, "TOO_LARGE")
    slot = hash_number("partition", F.coalesce(F.col(key).cast("string"), F.col(value)), partitions)
    return df.withColumn("error", error).withColumn("partition", F.when(F.col("error").isNull(), slot))


def log_to_metric(df: DataFrame, ts: str, late: str, window: str, dims: dict[str, str], body: str, value: str) -> DataFrame:
    """Metric rows from log entries: dimensions are fixed text or JSON paths ($...) of the body."""
    cols = [(F.get_json_object(body, v) if v.startswith("$") else F.lit(v)).alias(n) for n, v in dims.items()]
    rows = df.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, window), *cols).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def windowed(
    df: DataFrame, ts: str, late: str, size: str, by: list[str], aggs: dict[str, str], slide: str | None = None, session: bool = False
) -> DataFrame:
    """Tumbling, sliding (``slide``) or session (gap = ``size``) windows with a bound on lateness."""
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    if session:
        w = F.session_window(ts, size)
    else:
        w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = rows.groupBy(*by, w.alias("w")).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs)


#: How partial aggregates of a session are built and put together.
_PARTIAL = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def session_windows(df: DataFrame, ts: str, gap: str, by: list[str], aggs: dict[str, tuple[str, str]], chunk: str = "hour") -> DataFrame:
    """Session windows (``by, start, end`` and the aggregates) of a batch in which one key may hold all rows.

    Sessions are built per key and ``chunk``, a calendar unit, in tasks of their own.  Only those
    that reach to within ``gap`` of an end of their chunk can go on in another one: a key has few, and they
    are put together in a second step; all others are done.  ``aggs`` maps names to (count,
    sum, min or max, column).  The result equals ``session_window`` over the key.
    """
    first, second = ({n: _PARTIAL[kind][i] for n, (kind, _) in aggs.items()} for i in (0, 1))
    rows = df.where(F.col(ts).isNotNull())
    parts = rows.groupBy(*by, F.date_trunc(chunk, ts).cast(df.schema[ts].dataType).alias("_chunk"), F.session_window(ts, gap).alias("_w")).agg(*[first[n](c).alias(n) for n, (_, c) in aggs.items()])
    parts = parts.select(*by, "_chunk", F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *aggs)
    at_edge = (F.col("start") <= F.col("_chunk") + F.expr(f"INTERVAL {gap}")) | (F.col("end") >= F.col("_chunk") + step_of(chunk))
    parts = cut_lineage(parts.withColumn("_edge", at_edge))
    length = F.concat(F.timestamp_diff("MICROSECOND", F.col("start"), F.col("end")).cast("string"), F.lit(" microseconds"))
    whole = parts.where("_edge").groupBy(*by, F.session_window("start", length).alias("_w")).agg(*[second[n](n).alias(n) for n in aggs])
    whole = whole.select(*by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *aggs)
    return parts.where("NOT _edge").select(*by, "start", "end", *aggs).unionByName(whole)


def route(df: DataFrame, rules: list[tuple[object, list[str]]]) -> DataFrame:
    """One row per event and action of every rule that holds."""
    lists = [(cond, F.array(*[F.lit(a) for a in actions])) for cond, actions in rules]
    hit = F.array_distinct(F.flatten(all_matches(lists)))
    return df.withColumn("action", F.explode(hit))


def dedup_stream(df: DataFrame, key: list[str], ts: str, within: str) -> DataFrame:
    """The first message of each id; state for an id is dropped once the watermark passes it."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)


def normalise(
    df: DataFrame, body: str, routes: list[tuple[object, dict[str, str]]], default: dict[str, str], payload: str = "$"
) -> DataFrame:
    """Device payloads to long form (device, time, name, value).

    The first route whose condition holds gives the envelope: JSON paths or
    column names (written ``=col``) for ``device`` and ``time``.
    """
    pick = lambda spec: F.col(spec[1:]).cast("string") if spec.startswith("=") else F.get_json_object(body, spec)
    device = first_match([(c, pick(env["device"])) for c, env in routes], pick(default["device"]))
    time = first_match([(c, pick(env["time"])) for c, env in routes], pick(default["time"]))
    content = F.from_json(F.get_json_object(body, payload), "map<string,string>")
    return df.select(device.alias("device"), time.alias("time"), F.explode(content).alias("name", "value"))


def twin_state(df: DataFrame, device: str, order: list[str], values: list[str]) -> DataFrame:
    """Latest values per device; on a stream, run in update mode."""
    last = df.groupBy(device).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"), F.count("*").alias("messages"))
    return last.select(device, *[F.col(f"_v.{v}").alias(v) for v in values], "messages")


def message_states(log: DataFrame, message: str, action: str, order: list[str], value: str) -> DataFrame:
    """Per message: last action, number of deliveries and size; ``put`` and ``release`` make it visible, ``get`` takes it."""
    return log.groupBy(message).agg(
        F.max_by(action, F.struct(*order)).alias("last_action"),
        F.count_if(F.col(action) == "get").alias("deliveries"),
        F.max(value).alias("size"),
        F.count_if(F.col(action) == "put").alias("_puts"),
    ).where("_puts > 0").drop("_puts")


def queue_stats(states: DataFrame, queue: Column, limit: int) -> DataFrame:
    """Visible and in-flight messages, total size, and dead letters: not deleted and delivered more than ``limit`` times."""
    live = F.col("last_action") != "delete"
    dead = live & (F.col("deliveries") > limit)
    return states.groupBy(queue.alias("queue")).agg(
        F.count_if(live & ~dead & (F.col("last_action") != "get")).alias("visible"),
        F.count_if(live & ~dead & (F.col("last_action") == "get")).alias("in_flight"),
        F.sum(F.when(live, F.col("size")).otherwise(0)).alias("size"),
        F.count_if(dead).alias("dead_letters"),
    )
