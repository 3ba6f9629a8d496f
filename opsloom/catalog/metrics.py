"""Queries of the metric, alarm and forecast family."""

from pyspark.sql import functions as F

from opsloom.catalog.registry import query
from opsloom.operators import metrics as M

ALARM = M.AlarmRule("hour", "mean", ">", 55.0, pending=2, dims=["event_type"])


def points(t):
    """Metric points: name, dimension map, time, value."""
    dims = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    return t.events.select(F.col("event_type").alias("metric"), dims.alias("dims"), "ts", "value")


@query(
    "m1_list_metrics",
    """SELECT DISTINCT event_type AS name, d.k AS dimension, d.v AS value FROM (SELECT event_type, user_id::VARCHAR AS u, json_extract_string(props, '$.k') AS k
       FROM events WHERE json_extract_string(props, '$.k') = '69') e, LATERAL (VALUES ('user', e.u), ('k', e.k)) d(k, v)""",
)
def _(t):
    return M.list_metrics(points(t), "metric", "dims", {"k": "69"})


@query(
    "m2_summarise_metrics",
    """WITH b AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS bucket, value FROM events),
       a AS (SELECT event_type, bucket, avg(value) AS mean, sum(value) AS total, count(*) AS n, max(value) AS peak, quantile_cont(value, 0.95) AS p95 FROM b GROUP BY 1, 2),
       s AS (SELECT event_type, unnest(generate_series((SELECT min(bucket) FROM a), (SELECT max(bucket) FROM a), INTERVAL 1 HOUR)) AS bucket FROM (SELECT DISTINCT event_type FROM a))
       SELECT event_type, bucket, 'mean' AS stat, round(mean, 6) AS v FROM a
       UNION ALL SELECT event_type, bucket, 'sum', round(total, 6) FROM a
       UNION ALL SELECT event_type, bucket, 'max', round(peak, 6) FROM a
       UNION ALL SELECT event_type, bucket, 'p95', round(p95, 6) FROM a
       UNION ALL SELECT event_type, bucket, 'rate', round((mean - lag(mean) OVER w) / (epoch(bucket) - lag(epoch(bucket)) OVER w), 9) FROM a WINDOW w AS (PARTITION BY event_type ORDER BY bucket)
       UNION ALL SELECT event_type, bucket, 'count', n::DOUBLE FROM a
       UNION ALL SELECT event_type, bucket, 'absent', 1.0 FROM s ANTI JOIN a USING (event_type, bucket)""",
)
def _(t):
    stats = ["mean", "sum", "max", "p95", "rate", "count", "absent"]
    df = M.summarize_many(t.events, "ts", "value", "hour", stats, ["event_type"])
    return df.withColumn("v", F.when(F.col("stat") == "rate", F.round("v", 9)).otherwise(F.round("v", 6)))


@query(
    "m2_summarise_filled",
    """WITH a AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*)::DOUBLE AS v FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
       SELECT event_type, bucket, v FROM (SELECT event_type, unnest(generate_series((SELECT min(bucket) FROM a), (SELECT max(bucket) FROM a), INTERVAL 1 HOUR)) AS bucket
       FROM (SELECT DISTINCT event_type FROM a)) LEFT JOIN a USING (event_type, bucket)""",
)
def _(t):
    return M.summarize(t.events.where("event_type <> 'view'"), "ts", "value", "hour", "count", ["event_type"], fill=True)


@query(
    "m2_summarise_resolution",
    """WITH b AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS bucket, value FROM events, range(0, 6) g(i)),
       a AS (SELECT event_type, bucket, avg(value) AS mean, sum(value) AS total, count(*) AS n, min(value) AS least, max(value) AS most, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM b GROUP BY 1, 2),
       s AS (SELECT event_type, unnest(generate_series((SELECT min(bucket) FROM a), (SELECT max(bucket) FROM a), INTERVAL 30 MINUTE)) AS bucket FROM (SELECT DISTINCT event_type FROM a))
       SELECT event_type, bucket, 'mean' AS stat, round(mean, 6) AS v FROM a
       UNION ALL SELECT event_type, bucket, 'sum', round(total, 6) FROM a
       UNION ALL SELECT event_type, bucket, 'count', n::DOUBLE FROM a
       UNION ALL SELECT event_type, bucket, 'min', round(least, 6) FROM a
       UNION ALL SELECT event_type, bucket, 'max', round(most, 6) FROM a
       UNION ALL SELECT event_type, bucket, 'p50', round(p50, 6) FROM a
       UNION ALL SELECT event_type, bucket, 'p95', round(p95, 6) FROM a
       UNION ALL SELECT event_type, bucket, 'rate', round((mean - lag(mean) OVER w) / (epoch(bucket) - lag(epoch(bucket)) OVER w), 9) FROM a WINDOW w AS (PARTITION BY event_type ORDER BY bucket)
       UNION ALL SELECT event_type, bucket, 'absent', 1.0 FROM s ANTI JOIN a USING (event_type, bucket)""",
)
def _(t):
    """Three-hour summaries every half hour."""
    stats = ["mean", "sum", "count", "min", "max", "p50", "p95", "rate", "absent"]
    df = M.summarize_many(t.events, "ts", "value", "3 hours", stats, ["event_type"], resolution="30 minutes")
    return df.withColumn("v", F.when(F.col("stat") == "rate", F.round("v", 9)).otherwise(F.round("v", 6)))


STATES = """a AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS bucket, avg(value) AS v FROM events GROUP BY 1, 2),
 b AS (SELECT *, round(v, 9) > 55.0 AS breach FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket)
 - row_number() OVER (PARTITION BY event_type, breach ORDER BY bucket) AS g FROM b),
 st AS (SELECT event_type, bucket, v, breach, CASE WHEN breach THEN row_number() OVER (PARTITION BY event_type, breach, g ORDER BY bucket) ELSE 0 END AS run FROM r),
 states AS (SELECT *, CASE WHEN run >= 2 THEN 'FIRING' WHEN breach THEN 'PENDING' ELSE 'OK' END AS state FROM st)"""


def states(t):
    return M.evaluate_alarm(t.events, "ts", "value", ALARM)


@query("m3_alarm_evaluation", f"WITH {STATES} SELECT event_type, bucket, round(v, 6) AS v, run::INTEGER AS run, state FROM states")
def _(t):
    return states(t).select("event_type", "bucket", F.round("v", 6).alias("v"), "run", "state")


MOVES = """moves AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY event_type ORDER BY bucket) AS from_state FROM states)
 WHERE state IS DISTINCT FROM from_state)"""


@query(
    "m4_alarm_history",
    f"""WITH {STATES}, {MOVES} SELECT event_type, bucket, from_state, state AS to_state,
       date_diff('second', bucket, lead(bucket) OVER (PARTITION BY event_type ORDER BY bucket)) AS seconds FROM moves""",
)
def _(t):
    return M.alarm_history(states(t), ["event_type"])


@query(
    "m5_dimension_state",
    f"WITH {STATES} SELECT event_type, arg_max(state, bucket) AS state, max(bucket) AS since FROM states GROUP BY 1",
)
def _(t):
    return M.dimension_states(states(t), ["event_type"])


@query(
    "m6_suppression",
    f"""WITH {STATES}, win AS (SELECT 'click' AS event_type, TIMESTAMP '2024-01-03' AS s, TIMESTAMP '2024-01-05' AS e
       UNION ALL SELECT 'error', TIMESTAMP '2024-01-02 06:00:00' + to_days((7 * i)::INTEGER), TIMESTAMP '2024-01-02 18:00:00' + to_days((7 * i)::INTEGER) FROM range(0, 6) g(i)),
       w2 AS (SELECT s, e FROM (VALUES (TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-10 12:00:00')) v(s, e))
       SELECT event_type, bucket, state FROM states st WHERE NOT EXISTS (SELECT 1 FROM win WHERE win.event_type = st.event_type AND bucket >= s AND bucket < e)
       AND NOT EXISTS (SELECT 1 FROM w2 WHERE bucket >= s AND bucket < e)""",
)
def _(t):
    by_dim = t.spark.sql(
        """SELECT * FROM VALUES ('click', TIMESTAMP_NTZ '2024-01-03 00:00:00', TIMESTAMP_NTZ '2024-01-05 00:00:00', NULL),
           ('error', TIMESTAMP_NTZ '2024-01-02 06:00:00', TIMESTAMP_NTZ '2024-01-02 18:00:00', 7) AS v(event_type, start, end, repeat_days)"""
    )
    whole = t.spark.sql("SELECT TIMESTAMP_NTZ '2024-01-10 00:00:00' AS start, TIMESTAMP_NTZ '2024-01-10 12:00:00' AS end")
    left = M.suppress(states(t), M.recurring_windows(by_dim, "2024-02-06"), by=["event_type"])
    return M.suppress(left, whole).select("event_type", "bucket", "state")


BASE = """base AS (SELECT event_type, ((isodow(ts) - 1) * 24 + hour(ts))::INTEGER AS slot, quantile_cont(value, 0.1) AS low,
 quantile_cont(value, 0.5) AS expected, quantile_cont(value, 0.9) AS high FROM events GROUP BY 1, 2)"""


@query("m7_baseline", f"WITH {BASE} SELECT event_type, slot, round(low, 6) AS low, round(expected, 6) AS expected, round(high, 6) AS high FROM base")
def _(t):
    base = M.baseline(t.events, ["event_type"], "ts", "value")
    return base.select("event_type", "slot", *[F.round(c, 6).alias(c) for c in ("low", "expected", "high")])


@query(
    "m8_baseline_anomalies",
    f"""WITH {BASE} SELECT event_id, value, CASE WHEN value > high THEN 'above' ELSE 'below' END AS side FROM
       (SELECT *, ((isodow(ts) - 1) * 24 + hour(ts))::INTEGER AS slot FROM events) JOIN base USING (event_type, slot) WHERE value > high OR value < low""",
)
def _(t):
    base = M.baseline(t.events, ["event_type"], "ts", "value")
    return M.baseline_points(t.events, base, ["event_type"], "ts", "value").select("event_id", "value", "side")


@query(
    "m9_capacity_trend",
    """WITH s AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS usage, count(*) * 500000.0 AS capacity FROM orders GROUP BY 1, 2),
       f AS (SELECT o_orderpriority, regr_slope(usage, date_diff('day', (SELECT min(period) FROM s), period)) AS slope FROM s GROUP BY 1)
       SELECT o_orderpriority, period, round(usage, 2) AS usage, capacity::DOUBLE AS capacity, round(usage * 100 / capacity, 9) AS percent, round(slope, 4) AS slope_per_day FROM s JOIN f USING (o_orderpriority)""",
)
def _(t):
    df = M.usage_trend(t.orders, ["o_orderpriority"], "o_orderdate", "month", "sum(o_totalprice)", "count(*) * 500000.0D")
    return df.select(
        "o_orderpriority", "period", F.round("usage", 2).alias("usage"), "capacity", F.round("percent", 9).alias("percent"),
        F.round("slope_per_day", 4).alias("slope_per_day"),
    )


@query(
    "m10_forecast_linear",
    """WITH s AS (SELECT o_orderpriority, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) // 30)::BIGINT AS x, sum(o_totalprice) / 1000 AS y FROM orders GROUP BY 1, 2),
       f AS (SELECT o_orderpriority, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, regr_r2(y, x) AS r2,
       sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)) AS err, max(x) AS last FROM s GROUP BY 1)
       SELECT o_orderpriority, last + h AS x, round(b + a * (last + h), 4) AS forecast, round(b + a * (last + h) - 2 * err, 4) AS low, round(b + a * (last + h) + 2 * err, 4) AS high,
       round(a, 6) AS slope, round(r2, 6) AS r2 FROM f, range(1, 7) g(h)""",
)
def _(t):
    df = M.forecast(t.orders, ["o_orderpriority"], "o_orderdate", 30, "sum(o_totalprice) / 1000", 6)
    four = [F.round(c, 4).alias(c) for c in ("forecast", "low", "high")]
    return df.select("o_orderpriority", "x", *four, F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"))


@query(
    "m10_forecast_seasonal",
    """WITH s AS (SELECT event_type, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS x, sum(value) AS y FROM events GROUP BY 1, 2),
       f AS (SELECT event_type, regr_slope(y, x) AS slope, avg(y) - regr_slope(y, x) * avg(x) AS level, max(x) AS last FROM s GROUP BY 1),
       o AS (SELECT event_type, x % 7 AS slot, avg(y - level - slope * x) AS off FROM s JOIN f USING (event_type) GROUP BY 1, 2),
       a AS (SELECT event_type, last + i AS x, level + slope * (last + i) AS line FROM f, range(1, 15) g(i))
       SELECT a.event_type, x, round(line + coalesce(off, 0), 6) AS forecast FROM a LEFT JOIN o ON a.event_type = o.event_type AND a.x % 7 = o.slot""",
)
def _(t):
    origin = t.events.agg(F.min(F.to_date("ts"))).scalar()
    series = t.events.groupBy("event_type", F.datediff(F.to_date("ts"), origin).cast("bigint").alias("x")).agg(F.sum("value").alias("y"))
    return M.seasonal_forecast(series, ["event_type"], 7, 14).withColumn("forecast", F.round("forecast", 6))


@query(
    "m11_top_usage",
    """WITH s AS (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS bucket, l_suppkey, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1, 2)
       SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY v DESC, l_suppkey)::INTEGER AS rank FROM s) WHERE rank <= 5""",
)
def _(t):
    return M.top_usage(t.lineitem, "l_shipdate", "month", "l_suppkey", "round(sum(l_extendedprice), 2)", 5)


@query(
    "m12_sql_insights",
    """WITH s AS (SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts) AS x, avg(value) AS y FROM events GROUP BY 1, 2),
       a AS (SELECT user_id, regr_slope(y, x) AS slope, avg(y) AS mean, stddev_samp(y) / avg(y) AS variation FROM s GROUP BY 1)
       SELECT user_id, round(slope, 6) AS slope, round(mean, 6) AS mean, round(variation, 6) AS variation, coalesce(slope > 0.5, FALSE) AS degrading,
       coalesce(variation > 0.8, FALSE) AS variant, mean > 55 AS inefficient FROM a""",
)
def _(t):
    series = t.events.groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("x")).agg(F.avg("value").alias("y"))
    df = M.sql_insights(series, "user_id", "x", "y", {"slope": 0.5, "variation": 0.8, "mean": 55.0})
    return df.withColumns({c: F.round(c, 6) for c in ("slope", "mean", "variation")})


@query(
    "m13_response_distribution",
    """WITH c AS (SELECT event_type, ((value >= 10)::INTEGER + (value >= 50)::INTEGER + (value >= 100)::INTEGER + (value >= 200)::INTEGER) AS band, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT event_type, band, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY event_type), 6) AS share,
       round(sum(n) OVER (PARTITION BY event_type ORDER BY band)::DOUBLE / sum(n) OVER (PARTITION BY event_type), 6) AS cumulative FROM c""",
)
def _(t):
    return M.distribution(t.events, "value", [10, 50, 100, 200], ["event_type"])


@query(
    "m14_counter_rates",
    """WITH c AS (SELECT event_id, event_type, ts, event_id % 700 AS counter FROM events), g AS (SELECT *, counter - lag(counter) OVER w AS grown,
       (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0 AS secs FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
       SELECT event_id, CASE WHEN grown < 0 THEN counter ELSE grown END AS increment, coalesce(grown < 0, FALSE) AS is_reset,
       round(CASE WHEN grown < 0 THEN counter ELSE grown END / secs, 6) AS rate FROM g""",
)
def _(t):
    rows = t.events.select("event_id", "event_type", "ts", (F.col("event_id") % 700).alias("counter"))
    df = M.counter_rate(rows, ["event_type"], "ts", "counter", ["ts", "event_id"])
    return df.select("event_id", "increment", "is_reset", F.round("rate", 6).alias("rate"))


@query(
    "m15_top_waits",
    """SELECT event_type, round(sum(value), 2) AS total, count(*) AS waits, count(*) FILTER (WHERE value < 10) AS n_short,
       count(*) FILTER (WHERE value >= 10 AND value < 100) AS n_middle, count(*) FILTER (WHERE value >= 100) AS n_long FROM events GROUP BY 1 ORDER BY sum(value) DESC LIMIT 3""",
)
def _(t):
    bands = [("short", None, 10), ("middle", 10, 100), ("long", 100, None)]
    return M.top_waits(t.events, "event_type", "value", bands, 3).withColumn("total", F.round("total", 2))


@query(
    "m16_change_log",
    """SELECT o_orderkey, o_custkey, old_value, o_orderstatus FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old_value
       FROM orders) WHERE old_value IS NOT NULL AND old_value <> o_orderstatus""",
)
def _(t):
    df = M.changes(t.orders, ["o_custkey"], "o_orderstatus", ["o_orderdate", "o_orderkey"], F.date_trunc("month", "o_orderdate"))
    return df.select("o_orderkey", "o_custkey", "old_value", "o_orderstatus")


@query(
    "m17_rightsize",
    """SELECT user_id, round(quantile_cont(value, 0.9), 6) AS usage, CASE WHEN quantile_cont(value, 0.9) < 100 THEN 'DOWNSIZE'
       WHEN quantile_cont(value, 0.9) > 130 THEN 'UPSIZE' ELSE 'KEEP' END AS advice FROM events GROUP BY 1""",
)
def _(t):
    return M.rightsize(t.events, ["user_id"], "value", 0.9, 100.0, 130.0).withColumn("usage", F.round("usage", 6))
