"""Queries of the aggregation family."""

from pyspark.sql import functions as F

from opsloom.catalog.registry import query
from opsloom.operators import aggs as A
from opsloom.plans.predicates import Cond


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    "a1_aggregator",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
       round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    return A.aggregate(
        t.lineitem, ["l_returnflag", "l_linestatus"],
        {
            "n": "count(*)", "qty": "sum(l_quantity)", "revenue": "round(sum(l_extendedprice * (1 - l_discount)), 4)",
            "mean_discount": "round(avg(l_discount), 6)",
        },
    )


@query(
    "a2_stats",
    """SELECT event_type, count(value) AS n, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high,
       round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS med, round(quantile_cont(value, 0.95), 6) AS p95,
       count(DISTINCT user_id) AS users, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value
       FROM events GROUP BY event_type""",
)
def _(t):
    df = A.stats(
        t.events, ["event_type"],
        [
            ("count", "value", "n"), ("sum", "value", "total"), ("avg", "value", "mean"), ("min", "value", "low"), ("max", "value", "high"),
            ("stddev", "value", "sd"), ("median", "value", "med"), ("p95", "value", "p95"), ("distinct", "user_id", "users"),
            ("first", "value", "first_value"), ("last", "value", "last_value"),
        ],
        order=["event_id"],
    )
    return rounded(rounded(df, 6, "mean", "sd", "med", "p95"), 2, "total")


@query("a2_stats_values", "SELECT DISTINCT event_type, user_id FROM events")
def _(t):
    return A.distinct_values(t.events, ["event_type"], "user_id")


@query(
    "a3_time_stats",
    """WITH a AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2),
       s AS (SELECT event_type, unnest(generate_series((SELECT min(bucket) FROM a), (SELECT max(bucket) FROM a), INTERVAL 30 MINUTE)) AS bucket
       FROM (SELECT DISTINCT event_type FROM a))
       SELECT event_type, bucket, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM s LEFT JOIN a USING (event_type, bucket)""",
)
def _(t):
    return A.timestats(
        t.events, "ts", "30 minutes", {"n": "count(*)", "total": "round(sum(value), 2)"}, ["event_type"], {"n": 0, "total": 0.0}
    )


@query(
    "a4_geo_stats",
    """SELECT floor(((c_nationkey * 17) % 140 - 60 + (c_custkey % 90) / 10.0) / 15) * 15 AS cell_lat,
       floor(((c_nationkey * 41) % 360 - 180) / 15.0) * 15 AS cell_lon, count(*) AS n, round(sum(c_acctbal), 2) AS balance
       FROM customer GROUP BY 1, 2""",
)
def _(t):
    df = t.customer.withColumns(
        {
            "lat": F.expr("(c_nationkey * 17) % 140 - 60 + (c_custkey % 90) / 10.0D"),
            "lon": F.expr("(c_nationkey * 41) % 360 - 180"),
        }
    )
    return A.geostats(df, {"n": "count(*)", "balance": "round(sum(c_acctbal), 2)"}, "lat", "lon", 15.0)


@query("a5_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority, year(o_orderdate)::INTEGER AS y FROM orders")
def _(t):
    return A.distinct(t.orders.withColumn("y", F.year("o_orderdate")), ["o_orderstatus", "o_orderpriority", "y"])


@query(
    "a6_dedup",
    """SELECT 'first' AS mode, event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
       FROM events) WHERE rn <= 2
       UNION ALL SELECT 'consecutive', event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
       FROM events) WHERE p IS DISTINCT FROM event_type""",
)
def _(t):
    ev = t.events.select("event_id", "ts", "user_id", "event_type")
    first = A.dedup(ev, ["user_id", "event_type"], ["ts", "event_id"], 2)
    runs = A.dedup_consecutive(ev, ["user_id"], ["event_type"], ["ts", "event_id"], F.date_trunc("hour", "ts"))
    cols = ["event_id", "user_id", "event_type"]
    return first.select(F.lit("first").alias("mode"), *cols).unionByName(runs.select(F.lit("consecutive").alias("mode"), *cols))


@query(
    "a7_bucket",
    """SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity >= 10 AND l_quantity < 40 THEN 'medium' ELSE 'other' END AS label,
       floor(l_extendedprice / 10000) * 10000 AS band, CASE WHEN l_quantity < 1 THEN 0 WHEN l_quantity >= 50 THEN 6
       ELSE floor((l_quantity - 1) / 9.8) + 1 END::BIGINT AS slot, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""",
)
def _(t):
    df = A.bucket(t.lineitem, "l_quantity", "label", ranges=[("small", None, 10), ("medium", 10, 40)])
    df = A.bucket(df, "l_extendedprice", "band", span=10000)
    df = A.bucket(df, "l_quantity", "slot", bounds=(1.0, 50.0, 5))
    return df.groupBy("label", F.col("band").cast("double").alias("band"), "slot").agg(F.count("*").alias("n"))


@query(
    "a8_top_bottom",
    """(SELECT 'top' AS kind, p_partkey, p_brand, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)
       UNION ALL SELECT 'bottom' AS kind, p_partkey, p_brand, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand
       ORDER BY p_retailprice, p_partkey) AS rn FROM part) WHERE rn <= 3""",
)
def _(t):
    cols = ["p_partkey", "p_brand", "p_retailprice"]
    best = A.top(t.part.select(*cols), 10, "p_retailprice", ["p_partkey"])
    worst = A.top(t.part.select(*cols), 3, "p_retailprice", ["p_partkey"], ["p_brand"], bottom=True)
    return best.select(F.lit("top").alias("kind"), *cols).unionByName(worst.select(F.lit("bottom").alias("kind"), *cols))


@query(
    "a9_frequent_rare",
    """WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY event_type), 6) AS share,
       row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS f, row_number() OVER (PARTITION BY event_type ORDER BY n, user_id) AS r FROM c)
       SELECT 'frequent' AS kind, event_type, user_id, n, share FROM s WHERE f <= 5 UNION ALL SELECT 'rare', event_type, user_id, n, share FROM s WHERE r <= 5""",
)
def _(t):
    hot = A.frequent(t.events, ["user_id"], 5, ["event_type"])
    cold = A.frequent(t.events, ["user_id"], 5, ["event_type"], rare=True)
    return hot.select(F.lit("frequent").alias("kind"), "*").unionByName(cold.select(F.lit("rare").alias("kind"), "*"))


@query(
    "a10_pivot",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
       count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
)
def _(t):
    return A.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], {"n": "count(*)"}, name="{value}")


@query(
    "a11_macro_pivot",
    """SELECT l_linestatus, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS qty_of_A, max(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS peak_of_A,
       sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS qty_of_N, max(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS peak_of_N,
       sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS qty_of_R, max(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS peak_of_R
       FROM lineitem GROUP BY 1""",
)
def _(t):
    aggs = {"qty": "sum(l_quantity)", "peak": "max(l_extendedprice)"}
    return A.pivot(t.lineitem, ["l_linestatus"], "l_returnflag", ["A", "N", "R"], aggs, name="{agg}_of_{value}")


@query(
    "a12_link",
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
       SELECT user_id, session::BIGINT AS session, min(ts) AS "start", max(ts) AS "end", count(*) AS n, round(sum(value), 2) AS total,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 6) AS duration FROM s GROUP BY user_id, session""",
)
def _(t):
    df = A.link(t.events, ["user_id"], "ts", 21600, {"total": ("sum", "value")})
    return rounded(rounded(df, 6, "duration"), 2, "total")


@query(
    "a13_column_profile",
    """SELECT 'c_custkey' AS "column", count(c_custkey) AS n, count(*) - count(c_custkey) AS nulls, count(DISTINCT c_custkey) AS "distinct",
         min(c_custkey)::VARCHAR AS "min", max(c_custkey)::VARCHAR AS "max", round(avg(c_custkey), 6) AS mean,
         (SELECT c_custkey::VARCHAR FROM customer GROUP BY c_custkey ORDER BY count(*) DESC, c_custkey::VARCHAR LIMIT 1) AS top_value FROM customer
       UNION ALL SELECT 'c_name', count(c_name), count(*) - count(c_name), count(DISTINCT c_name), min(c_name), max(c_name), NULL,
         (SELECT c_name FROM customer GROUP BY c_name ORDER BY count(*) DESC, c_name LIMIT 1) FROM customer
       UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(*) - count(c_nationkey), count(DISTINCT c_nationkey), min(c_nationkey)::VARCHAR,
         max(c_nationkey)::VARCHAR, round(avg(c_nationkey), 6), (SELECT c_nationkey::VARCHAR FROM customer GROUP BY c_nationkey ORDER BY count(*) DESC,
         c_nationkey::VARCHAR LIMIT 1) FROM customer
       UNION ALL SELECT 'c_acctbal', count(c_acctbal), count(*) - count(c_acctbal), count(DISTINCT c_acctbal), min(c_acctbal)::VARCHAR, max(c_acctbal)::VARCHAR,
         round(avg(c_acctbal), 6), (SELECT c_acctbal::VARCHAR FROM customer GROUP BY c_acctbal ORDER BY count(*) DESC, c_acctbal::VARCHAR LIMIT 1) FROM customer
       UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment),
         NULL, (SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1) FROM customer""",
)
def _(t):
    return rounded(A.profile(t.customer), 6, "mean")


@query(
    "a14_faceted_counts",
    """WITH f AS (SELECT 'p_type' AS facet, p_type AS value FROM part WHERE p_size > 20
       UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part WHERE p_type = 'SMALL'
       UNION ALL SELECT 'p_brand', p_brand FROM part WHERE p_size > 20 AND p_type = 'SMALL'),
       c AS (SELECT facet, value, count(*) AS n FROM f GROUP BY 1, 2)
       SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rn FROM c) WHERE rn <= 8""",
)
def _(t):
    filters = {"p_size": Cond("p_size", ">", 20), "p_type": Cond("p_type", "=", "SMALL")}
    return A.facets(t.part, ["p_type", "p_size", "p_brand"], filters, 8)


@query(
    "a15_dimension_analytics",
    """SELECT CASE WHEN grouping(o_orderstatus) = 1 AND grouping(o_orderpriority) = 1 THEN 'total' ELSE concat_ws(',',
       CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' END, CASE WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' END) END AS level,
       o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
       GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""",
)
def _(t):
    return A.analytics(
        t.orders, ["o_orderstatus", "o_orderpriority"], {"n": "count(*)", "total": "round(sum(o_totalprice), 2)"},
        [["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []],
    )


@query(
    "a16_status_counts",
    """SELECT year(o_orderdate)::INTEGER AS y, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1""",
)
def _(t):
    return A.status_counts(t.orders.withColumn("y", F.year("o_orderdate")), ["y"], "o_orderstatus", ["F", "O", "P"])


@query(
    "a17_summary_block",
    """SELECT l_returnflag, min(l_extendedprice) AS "min", max(l_extendedprice) AS "max", round(avg(l_extendedprice), 6) AS mean,
       round(stddev_samp(l_extendedprice), 4) AS stddev, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem GROUP BY 1""",
)
def _(t):
    df = A.summary_stats(t.lineitem, ["l_returnflag"], "l_extendedprice")
    return rounded(rounded(df, 6, "mean", "q1", "median", "q3"), 4, "stddev")


@query(
    "a18_approximate_stats",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, TRUE AS parts_close, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
       TRUE AS median_close FROM lineitem GROUP BY 1""",
)
def _(t):
    """Sketch answers beside exact ones; the check is the error bound."""
    specs = [("distinct", "l_partkey", "parts"), ("median", "l_extendedprice", "median")]
    exact = A.stats(t.lineitem, ["l_returnflag"], specs)
    rough = A.stats(t.lineitem, ["l_returnflag"], [(k, c, f"{n}_a") for k, c, n in specs], approx=True)
    near = lambda a, b, tol: (F.abs(F.col(a) - F.col(b)) <= tol * F.abs(F.col(b)))
    return exact.join(rough, "l_returnflag").select(
        "l_returnflag", "parts", near("parts_a", "parts", 0.15).alias("parts_close"), F.round("median", 6).alias("median"),
        near("median_a", "median", 0.01).alias("median_close"),
    )


@query(
    "a19_event_rollup",
    """WITH d AS (SELECT user_id, date_trunc('day', ts) AS slot, count(*) AS c, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1, 2)
       SELECT user_id, sum(c)::BIGINT AS events, sum(e)::BIGINT AS errors, count(*) AS active, max(c) AS busiest FROM d GROUP BY 1""",
)
def _(t):
    return A.summarize_events(t.events, ["user_id"], "ts", "day", F.col("event_type") == "error")


@query(
    "a20_activity",
    """WITH c AS (SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS period, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT period, o_custkey, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY period), 6) AS share, rank() OVER (PARTITION BY period ORDER BY n DESC) AS rank FROM c""",
)
def _(t):
    return A.activity(t.orders, "o_custkey", "o_orderdate", "year")
