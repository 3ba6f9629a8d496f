"""Queries of the streaming family: each stream is run to its end and the result compared."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from opsloom.catalog.registry import query
from opsloom.operators.metrics import AlarmRule
from opsloom.plans.predicates import Cond
from opsloom.plans.storage import shared_path
from opsloom.streaming import alarms as A
from opsloom.streaming import operators as Z
from opsloom.streaming import runs as R
from opsloom.streaming import schedule as S


def events_stream(t, **position):
    return R.stream_source(t.spark, f"{t.folder}/events.parquet*", t.events.schema, **position)


def plain_time(df, *cols):
    return df.withColumns({c: R.utc_wall(c) for c in cols})


@query(
    "z1_stream_positions",
    """SELECT 'TRIM_HORIZON' AS start, count(*) AS n, round(sum(value), 2) AS total FROM events
       UNION ALL SELECT 'time', count(*), round(sum(value), 2) FROM events WHERE ts >= TIMESTAMP '2024-01-15'
       UNION ALL SELECT 'LATEST since 1990', count(*), round(sum(value), 2) FROM events""",
)
def _(t):
    whole = R.run_to_end(events_stream(t).select("value"), "horizon").select(F.lit("TRIM_HORIZON").alias("start"), "value")
    late = R.run_to_end(events_stream(t, start="2024-01-15 00:00:00", ts="ts").select("value"), "position")
    fresh = R.run_to_end(events_stream(t, start="LATEST").select("value"), "latest").select(F.lit("LATEST").alias("start"), "value")
    since = R.run_to_end(events_stream(t, start="LATEST", newer_than="1990-01-01 00:00:00").select("value"), "since").select(F.lit("LATEST since 1990").alias("start"), "value")
    rows = whole.unionByName(late.select(F.lit("time").alias("start"), "value")).unionByName(fresh).unionByName(since)
    return rows.groupBy("start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("z2_group_cursor", "SELECT 1 AS run, count(*) AS n FROM events UNION ALL SELECT 2, 0")
def _(t):
    """The second run of the same consumer group finds nothing new."""
    progress = shared_path(t.spark, "group-a")
    out = None
    for run in (1, 2):
        rows = R.run_to_end(events_stream(t).select("event_id"), f"run{run}", progress=progress)
        count = rows.agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), "n")
        out = count if out is None else out.unionByName(count)
    return out


@query(
    "z3_keyed_publish",
    """SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN 'TOO_LARGE' END AS error, CASE WHEN strlen(text) <= 4000 THEN ('0x' || substr(md5('partition|' || source), 1, 8))::BIGINT % 8 END AS partition FROM documents""",
)
def _(t):
    return Z.put_messages(t.documents, "source", "text", 8, 4000).select("doc_id", "error", "partition")


@query("z4_connector", "SELECT event_id, upper(event_type) AS kind, value FROM events WHERE event_type IN ('error', 'purchase') AND value > 10")
def _(t):
    target = shared_path(t.spark, "connector")
    task = lambda df: df.select("event_id", F.upper("event_type").alias("kind"), "value")
    source = events_stream(t)
    R.connect(source, target, "event_type IN ('error', 'purchase') AND value > 10", task).awaitTermination()
    return R.read_result(t.spark, target, task(source).schema).drop("batch")


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(
    "z5_log_to_metric",
    f"""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, json_extract_string(props, '$.k') AS k, 'app' AS source, count(*) AS n, round(sum(value), 2) AS total FROM events
       GROUP BY 1, 2 HAVING time_bucket(INTERVAL 6 HOUR, any_value(ts)) + INTERVAL 6 HOUR <= {CLOSED}""",
)
def _(t):
    rows = Z.log_to_metric(R.zoned(events_stream(t), "ts"), "ts", "1 hour", "6 hours", {"k": "$.k", "source": "app"}, "props", "value")
    done = R.run_to_end(rows.select(F.col("window.start").alias("start"), "k", "source", "n", "total"), "metrics")
    return plain_time(done, "start").select("start", "k", "source", "n", F.round("total", 2).alias("total"))


@query(
    "z6_windowed_lateness",
    f"""WITH slide AS (SELECT event_type, time_bucket(INTERVAL 2 HOUR, ts) - i * INTERVAL 2 HOUR AS start, value FROM events, range(0, 3) g(i)),
       gaps AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
       ses AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM gaps),
       u AS (SELECT 'tumbling' AS kind, event_type, time_bucket(INTERVAL 3 HOUR, ts) AS start, time_bucket(INTERVAL 3 HOUR, ts) + INTERVAL 3 HOUR AS "end", count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 2, 3, 4
       UNION ALL SELECT 'sliding', event_type, start, start + INTERVAL 6 HOUR, count(*), round(sum(value), 2) FROM slide GROUP BY 2, 3, 4
       UNION ALL SELECT 'session', event_type, min(ts), max(ts) + INTERVAL 1 HOUR, count(*), round(sum(value), 2) FROM ses GROUP BY event_type, s)
       SELECT * FROM u WHERE "end" <= {CLOSED}""",
)
def _(t):
    aggs = {"n": "count(*)", "total": "sum(value)"}
    out = None
    for kind, size, slide in (("tumbling", "3 hours", None), ("sliding", "6 hours", "2 hours"), ("session", "1 hour", None)):
        rows = Z.windowed(R.zoned(events_stream(t), "ts"), "ts", "1 hour", size, ["event_type"], aggs, slide, kind == "session")
        done = R.run_to_end(rows, kind).drop("batch").select(F.lit(kind).alias("kind"), "*")
        out = done if out is None else out.unionByName(done)
    return plain_time(out, "start", "end").withColumn("total", F.round("total", 2))


@query(
    "z6_sessions_of_hot_keys",
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
       SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 2) AS total, max(value) AS most FROM s GROUP BY event_type, s""",
)
def _(t):
    df = Z.session_windows(t.events, "ts", "30 minutes", ["event_type"], {"n": ("count", "event_id"), "total": ("sum", "value"), "most": ("max", "value")}, "day")
    return df.withColumn("total", F.round("total", 2))


@query(
    "z7_event_routing",
    """WITH r AS (SELECT event_id, 'notify' AS action FROM events WHERE event_type = 'error' UNION SELECT event_id, 'store' FROM events WHERE event_type = 'error' OR value > 100
       UNION SELECT event_id, 'bill' FROM events WHERE event_type = 'purchase') SELECT event_id, action FROM r""",
)
def _(t):
    rules = [(Cond("event_type", "=", "error"), ["notify", "store"]), (Cond("value", ">", 100), ["store"]), (Cond("event_type", "=", "purchase"), ["bill"])]
    rows = Z.route(events_stream(t), rules).select("event_id", "action")
    return R.run_to_end(rows, "routes").drop("batch")


@query(
    "z8_alarm_on_stream",
    f"""WITH a AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS bucket, avg(value) AS v FROM events GROUP BY 1, 2), c AS (SELECT * FROM a WHERE bucket + INTERVAL 1 HOUR <= {CLOSED}),
       b AS (SELECT *, round(v, 9) > 55.0 AS breach FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket) - row_number() OVER (PARTITION BY event_type, breach ORDER BY bucket) AS g FROM b),
       st AS (SELECT event_type, bucket, breach, CASE WHEN breach THEN row_number() OVER (PARTITION BY event_type, breach, g ORDER BY bucket) ELSE 0 END AS run FROM r)
       SELECT event_type, bucket, run::INTEGER AS run, CASE WHEN run >= 2 THEN 'FIRING' WHEN breach THEN 'PENDING' ELSE 'OK' END AS state FROM st""",
)
def _(t):
    rule = AlarmRule("hour", "mean", ">", 55.0, pending=2)
    rows = A.alarm_stream(R.zoned(events_stream(t), "ts"), "ts", "value", "1 hour", "1 hour", "event_type", rule)
    return R.run_to_end(rows, "alarms").select(F.col("key").alias("event_type"), "bucket", "run", "state")


@query(
    "z8_absence_on_stream",
    f"""WITH a AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS bucket, avg(value) AS v FROM events GROUP BY 1, 2), c AS (SELECT * FROM a WHERE bucket + INTERVAL 1 DAY <= {CLOSED}),
       n AS (SELECT *, lead(bucket) OVER (PARTITION BY user_id ORDER BY bucket) AS next, lag(bucket) OVER (PARTITION BY user_id ORDER BY bucket) AS last FROM c),
       gone AS (SELECT user_id, bucket + INTERVAL 3 DAY AS bucket FROM n WHERE next - bucket > INTERVAL 3 DAY OR (next IS NULL AND bucket + INTERVAL 4 DAY <= {CLOSED})),
       b AS (SELECT user_id, bucket, round(v, 9) > 40.0 AS breach, count(*) FILTER (NOT round(v, 9) > 40.0 OR last IS NULL OR bucket - last > INTERVAL 3 DAY) OVER w AS g, bucket - last > INTERVAL 3 DAY AS fresh FROM n WINDOW w AS (PARTITION BY user_id ORDER BY bucket)),
       st AS (SELECT user_id, bucket, breach, count(*) FILTER (breach) OVER (PARTITION BY user_id, g ORDER BY bucket) AS run FROM b)
       SELECT user_id::VARCHAR AS user_id, bucket, CASE WHEN breach THEN run ELSE 0 END::INTEGER AS run, CASE WHEN breach AND run >= 2 THEN 'FIRING' WHEN breach THEN 'PENDING' ELSE 'OK' END AS state FROM st
       UNION ALL SELECT user_id::VARCHAR, bucket, 0, 'ABSENT' FROM gone""",
)
def _(t):
    rule = AlarmRule("day", "mean", ">", 40.0, pending=2)
    rows = A.alarm_stream(R.zoned(events_stream(t), "ts"), "ts", "value", "1 hour", "1 day", "user_id", rule, absent=3)
    return R.run_to_end(rows, "absence").select(F.col("key").alias("user_id"), "bucket", "run", "state")


@query("z9_stream_dedup", "SELECT event_id, event_type, value FROM events")
def _(t):
    stream = R.zoned(events_stream(t), "ts")
    twice = stream.unionByName(stream.where("event_type IN ('error', 'click')"))
    rows = Z.dedup_stream(twice, ["event_id"], "ts", "1 hour").select("event_id", "event_type", "value")
    return R.run_to_end(rows, "dedup").drop("batch")


@query(
    "z10_device_payload_routing",
    """SELECT CASE WHEN event_type = 'error' THEN 'gate' || user_id ELSE user_id::VARCHAR END AS device, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events
       UNION ALL SELECT 'gate' || user_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), 'code', event_type FROM events WHERE event_type = 'error'""",
)
def _(t):
    plain = F.concat(F.lit('{"body": '), "props", F.lit("}"))
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    wrapped = F.concat(
        F.lit('{"env": {"id": "gate'), F.col("user_id").cast("string"), F.lit('", "at": "'), at, F.lit('"}, "body": {"k": "'),
        F.get_json_object("props", "$.k"), F.lit('", "code": "error"}}'),
    )
    is_gate = Cond("event_type", "=", "error")
    rows = t.events.withColumn("body", F.when(F.col("event_type") == "error", wrapped).otherwise(plain)).withColumn("at", at)
    return Z.normalise(rows, "body", [(is_gate, {"device": "$.env.id", "time": "$.env.at"})], {"device": "=user_id", "time": "=at"}, "$.body")


@query(
    "z11_latest_device_state",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS messages FROM events GROUP BY 1",
)
def _(t):
    rows = Z.twin_state(events_stream(t), "user_id", ["ts", "event_id"], ["event_type", "value"])
    return R.last_update(R.run_to_end(rows, "twin", "update"), ["user_id"])


@query(
    "z12_queue_stats",
    """WITH q AS (SELECT (event_id * 7919) % 1201 AS message, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'release' ELSE 'get' END AS action, event_id, length(props)::BIGINT AS size FROM events),
       m AS (SELECT message, arg_max(action, event_id) AS last, count(*) FILTER (WHERE action = 'get') AS d, max(size) AS size FROM q GROUP BY 1 HAVING count(*) FILTER (WHERE action = 'put') > 0)
       SELECT message % 5 AS queue, count(*) FILTER (WHERE last <> 'delete' AND d <= 4 AND last <> 'get') AS visible, count(*) FILTER (WHERE last = 'get' AND d <= 4) AS in_flight,
       coalesce(sum(size) FILTER (WHERE last <> 'delete'), 0)::BIGINT AS size, count(*) FILTER (WHERE last <> 'delete' AND d > 4) AS dead_letters FROM m GROUP BY 1""",
)
def _(t):
    action = F.expr("CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'release' ELSE 'get' END")
    log = t.events.select((F.col("event_id") * 7919 % 1201).alias("message"), action.alias("action"), "ts", "event_id", F.length("props").cast("bigint").alias("size"))
    states = Z.message_states(log, "message", "action", ["ts", "event_id"], "size")
    return Z.queue_stats(states, F.col("message") % 5, 4)


@query(
    "z13_continuous_query",
    """SELECT run, run_time, event_type, count(*) AS n FROM (SELECT i AS run, TIMESTAMP '2024-01-08' + to_days((7 * i)::INTEGER) AS run_time FROM range(0, 1000) g(i)) JOIN events ON ts < run_time
       WHERE run_time <= (SELECT max(ts) FROM events) GROUP BY 1, 2, 3""",
)
def _(t):
    """A weekly count of all events so far, by the clock of the events; a second start of the schedule finds its runs done."""
    target, start, every = shared_path(t.spark, "scheduled"), datetime(2024, 1, 8), timedelta(days=7)
    report = lambda spark, due: spark.read.parquet(f"{t.folder}/events.parquet").where(F.col("ts") < F.lit(due)).groupBy("event_type").agg(F.count("*").alias("n"))
    for _ in range(2):
        S.scheduled(events_stream(t).select("ts"), "ts", report, target, start, every).awaitTermination()
    return S.results(t.spark, target, report(t.spark, start).schema)
