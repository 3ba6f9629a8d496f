"""Queries of the trace family."""

from pyspark.sql import functions as F

from opsloom.catalog.registry import query
from opsloom.operators import traces as T
from opsloom.plans.predicates import Cond, Negate, all_of

SPANS = """spans AS (SELECT conv_id AS trace_id, turn AS span_id, CASE WHEN turn > 0 THEN turn - 1 END AS parent_id, role AS service,
 TIMESTAMP '2024-01-01' + to_minutes((conv_id % 40000) * 5 + turn) AS start, length(text)::BIGINT AS duration_ms, (length(text) % 7 = 0)::INTEGER AS error FROM conversations)"""


def spans(t):
    """Spans from conversations: a conversation is a trace, a turn is a span called by the turn before."""
    begin = F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, (conv_id % 40000) * 5 + turn)")
    return t.conversations.select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"),
        F.col("role").alias("service"), begin.alias("start"), F.length("text").cast("bigint").alias("duration_ms"),
        (F.length("text") % 7 == 0).cast("int").alias("error"),
    )


@query(
    "t1_trace_summary",
    f"""WITH {SPANS} SELECT trace_id, arg_min(service, span_id) FILTER (WHERE parent_id IS NULL) AS root_service, min(start) AS start, count(*) AS spans, sum(error)::BIGINT AS errors,
       (SELECT string_agg(service, ',' ORDER BY service) FROM (SELECT DISTINCT service FROM spans i WHERE i.trace_id = o.trace_id)) AS services,
       round(max(epoch_us(start) / 1000.0 + duration_ms) - min(epoch_us(start) / 1000.0), 3) AS duration_ms FROM spans o GROUP BY trace_id""",
)
def _(t):
    return T.traces(spans(t)).withColumn("duration_ms", F.round("duration_ms", 3))


@query(
    "t2_trace_query",
    f"""WITH {SPANS} SELECT service, error, count(*) AS n, max(duration_ms) AS slowest FROM spans WHERE duration_ms > 100 GROUP BY 1, 2 ORDER BY service, error LIMIT 5""",
)
def _(t):
    return T.trace_query(
        spans(t), ["service", "error", "n", "slowest"], [Cond("duration_ms", ">", 100)], ["service", "error"],
        {"n": "count(*)", "slowest": "max(duration_ms)"}, ["service", "error"], 5,
    )


@query(
    "t3_topology",
    f"""WITH {SPANS} SELECT p.service AS caller, c.service AS callee, count(*) AS calls, sum(c.error)::BIGINT AS errors, round(avg(c.duration_ms), 6) AS mean_ms, max(c.duration_ms) AS max_ms
       FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id GROUP BY 1, 2""",
)
def _(t):
    return T.topology(spans(t)).withColumn("mean_ms", F.round("mean_ms", 6))


@query(
    "t4_span_filter",
    """WITH f AS (SELECT * FROM events WHERE value > 20 AND event_type <> 'view'), a AS (SELECT 'k' AS attribute FROM f WHERE json_extract_string(props, '$.k') IS NOT NULL
       UNION ALL SELECT 'kind_' || event_type FROM f UNION ALL SELECT 'user' FROM f WHERE user_id % 2 = 0)
       SELECT attribute, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM f), 6) AS share FROM a GROUP BY 1 ORDER BY n DESC, attribute LIMIT 4""",
)
def _(t):
    rows = T.span_filter(t.events, all_of(Cond("value", ">", 20), Negate(Cond("event_type", "=", "view"))))
    extra = F.create_map(F.concat(F.lit("kind_"), "event_type"), F.lit("1"))
    user = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("user"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("attributes", F.map_concat(F.from_json("props", "map<string,string>"), extra, user))
    return T.pinned_attributes(rows, "attributes", 4)


@query(
    "t5_apdex",
    """WITH r AS (SELECT 'all' AS rule, 20.0 AS t, value AS v FROM events UNION ALL SELECT 'purchase', 30.0, value FROM events WHERE event_type = 'purchase')
       SELECT rule, count(*) AS n, round((count(*) FILTER (WHERE v <= t) + count(*) FILTER (WHERE v > t AND v <= 4 * t) / 2.0) / count(*), 6)::DOUBLE AS apdex FROM r GROUP BY 1""",
)
def _(t):
    df = T.apdex(t.events, "value", [("all", "true", 20.0), ("purchase", Cond("event_type", "=", "purchase"), 30.0)])
    return df.withColumn("apdex", F.round("apdex", 6))


@query(
    "t6_span_metrics",
    f"""WITH {SPANS} SELECT service, date_trunc('hour', start)::TIMESTAMP AS bucket, round(quantile_cont(duration_ms, 0.9), 6) AS v FROM spans WHERE error = 0 GROUP BY 1, 2""",
)
def _(t):
    return T.span_metrics(spans(t), Cond("error", "=", 0), "hour", "p90", ["service"]).withColumn("v", F.round("v", 6))


@query(
    "t7_stack_aggregation",
    """WITH p AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS f FROM pages),
       e AS (SELECT f, unnest(range(1, len(f) + 1)) AS depth FROM p)
       SELECT array_to_string(f[1:depth], '/') AS prefix, depth::INTEGER AS depth, count(*) AS hits, count(*) FILTER (WHERE depth = len(f)) AS self_hits FROM e GROUP BY 1, 2""",
)
def _(t):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    frames = F.filter(F.split(path, "/"), lambda x: x != "")
    return T.aggregate_stacks(t.pages.select(frames.alias("frames")), "frames")


@query(
    "t8_probe_stats",
    """SELECT user_id, count(*) AS probes, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS loss,
       round(quantile_cont(value, 0.5) FILTER (WHERE event_type <> 'error'), 6) AS p50, round(quantile_cont(value, 0.9) FILTER (WHERE event_type <> 'error'), 6) AS p90,
       round(quantile_cont(value, 0.99) FILTER (WHERE event_type <> 'error'), 6) AS p99 FROM events GROUP BY 1""",
)
def _(t):
    df = T.probe_stats(t.events, ["user_id"], "value", Cond("event_type", "=", "error"))
    return df.withColumns({c: F.round(c, 6) for c in ("loss", "p50", "p90", "p99")})
