"""Queries of the sort, set and window family."""

from pyspark.sql import functions as F

from opsloom.catalog.registry import query
from opsloom.operators import windows as W


@query("w1_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def _(t):
    df = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return W.sort(df, [("o_orderpriority", "asc", "last"), ("o_totalprice", "desc", "last"), ("o_orderkey", "asc", "first")])


@query(
    "w2_head_tail",
    """(SELECT 'head' AS part, event_id, value FROM events ORDER BY value, event_id LIMIT 20)
       UNION ALL (SELECT 'tail' AS part, event_id, value FROM events ORDER BY value DESC, event_id DESC LIMIT 20)""",
)
def _(t):
    cols = ["event_id", "value"]
    first = W.head(t.events.select(*cols), 20, ["value", "event_id"]).select(F.lit("head").alias("part"), *cols)
    return first.unionByName(W.tail(t.events.select(*cols), 20, ["value", "event_id"]).select(F.lit("tail").alias("part"), *cols))


@query(
    "w3_union",
    """SELECT 'all' AS kind, nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 2
       UNION ALL SELECT 'distinct', nation, count(*) FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier) GROUP BY 2""",
)
def _(t):
    a = t.customer.select(F.col("c_nationkey").alias("nation"))
    b = t.supplier.select(F.col("s_nationkey").alias("nation"))
    count = lambda df, kind: df.groupBy("nation").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "nation", "n")
    return count(W.union([a, b]), "all").unionByName(count(W.union([a, b], by="position", all=False), "distinct"))


@query(
    "w4_intersect",
    """WITH a AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
       SELECT 'set' AS kind, o_custkey FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
       UNION ALL SELECT 'bag', o_custkey FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)""",
)
def _(t):
    a = t.orders.where("o_orderstatus = 'F'").select("o_custkey")
    b = t.orders.where("o_orderstatus = 'P'").select("o_custkey")
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "o_custkey")
    return tag(W.intersect(a, b), "set").unionByName(tag(W.intersect(a, b, all=True), "bag"))


@query(
    "w5_minus",
    """WITH a AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
       SELECT 'set' AS kind, o_custkey FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
       UNION ALL SELECT 'bag', o_custkey FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
)
def _(t):
    a = t.orders.where("o_orderstatus = 'F'").select("o_custkey")
    b = t.orders.where("o_orderstatus = 'P'").select("o_custkey")
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "o_custkey")
    return tag(W.minus(a, b), "set").unionByName(tag(W.minus(a, b, all=True), "bag"))


@query(
    "w6_delta",
    """SELECT event_id, round(value - lag(value) OVER w, 6) AS value_delta,
       round((value - lag(value) OVER w) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0), 6) AS value_rate
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def _(t):
    df = W.delta(t.events, ["value"], ["event_type"], "ts", ["ts", "event_id"])
    return df.select("event_id", F.round("value_delta", 6).alias("value_delta"), F.round("value_rate", 6).alias("value_rate"))


@query(
    "w7_sequence",
    """WITH a AS (SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING
       AND 1 PRECEDING) AS s1 FROM events), b AS (SELECT *, max(CASE WHEN event_type = 'click' THEN s1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s2 FROM a)
       SELECT event_id, user_id, s2 AS chain_start FROM b WHERE event_type = 'purchase' AND epoch_us(ts) - epoch_us(s2) <= 172800000000""",
)
def _(t):
    steps = [F.col("event_type") == s for s in ("view", "click", "purchase")]
    df = W.sequence(t.events, ["user_id"], "ts", steps, 172800, ["ts", "event_id"])
    return df.select("event_id", "user_id", "chain_start")


SERIES = """WITH a AS (SELECT {key}, date_trunc('{span}', ts)::TIMESTAMP AS bucket, {agg} AS v FROM events GROUP BY 1, 2),
 s AS (SELECT {key}, unnest(generate_series((SELECT min(bucket) FROM a), (SELECT max(bucket) FROM a), INTERVAL 1 {span})) AS bucket
 FROM (SELECT DISTINCT {key} FROM a)), f AS (SELECT {key}, bucket, coalesce(v, 0) AS v FROM s LEFT JOIN a USING ({key}, bucket))"""


@query(
    "w8_trend",
    SERIES.format(key="event_type", span="day", agg="count(*)::DOUBLE")
    + """ SELECT event_type, string_agg(v::BIGINT::VARCHAR, ',' ORDER BY bucket) AS points,
       round(regr_slope(v, epoch(bucket - (SELECT min(bucket) FROM a))) * 86400, 6) AS slope FROM f GROUP BY 1""",
)
def _(t):
    df = W.trend(t.events, ["event_type"], "ts", "day", "count(*)")
    points = F.array_join(F.transform("points", lambda v: v.cast("bigint").cast("string")), ",")
    return df.select("event_type", points.alias("points"), F.round(F.col("slope") * 86400, 6).alias("slope"))


@query(
    "w9_time_cluster",
    SERIES.format(key="user_id", span="week", agg="count(*)::DOUBLE")
    + """, m AS (SELECT user_id, bucket, v - lag(v) OVER (PARTITION BY user_id ORDER BY bucket) AS d FROM f),
       g AS (SELECT user_id, string_agg(CASE WHEN d > 0 THEN '+' WHEN d < 0 THEN '-' WHEN d = 0 THEN '=' ELSE '' END, '' ORDER BY bucket) AS shape FROM m GROUP BY 1)
       SELECT shape, count(*) AS members, min(user_id) AS example FROM g GROUP BY 1""",
)
def _(t):
    return W.timecluster(t.events, "user_id", "ts", "week", "count(*)")
