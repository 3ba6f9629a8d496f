"""Queries of the usage and cost family."""

from pyspark.sql import functions as F

from opsloom.catalog.registry import query
from opsloom.operators import billing as U
from opsloom.plans.predicates import Cond, Negate, all_of, any_of

USAGE = """u AS (SELECT l_shipdate AS day, l_partkey AS sku, r_name || '/' || n_name || '/' || s_name AS path, n_name AS compartment, r_name AS region,
 l_quantity AS quantity, l_extendedprice AS cost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey)"""


def usage_lines(t):
    """Usage lines: lineitem with the supplier's place as compartment path."""
    place = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.lineitem.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_shipdate").alias("day"), F.col("l_partkey").alias("sku"), F.concat_ws("/", "r_name", "n_name", "s_name").alias("path"),
        F.col("n_name").alias("compartment"), F.col("r_name").alias("region"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("cost"),
    )


@query(
    "u1_summarised_usage",
    f"""WITH {USAGE} SELECT date_trunc('month', day)::TIMESTAMP AS period, region, sum(quantity) AS quantity, round(sum(cost), 2) AS cost FROM u
       WHERE day >= TIMESTAMP '1997-01-01' AND day < TIMESTAMP '1999-01-01' AND (region IN ('ASIA', 'EUROPE') OR compartment = 'NATION_1') AND NOT (quantity < 3) GROUP BY 1, 2
       UNION ALL SELECT date_trunc('day', day)::TIMESTAMP, region, sum(quantity), round(sum(cost), 2) FROM u
       WHERE day >= TIMESTAMP '1999-12-02' AND day < TIMESTAMP '2000-01-01' AND region = 'ASIA' GROUP BY 1, 2""",
)
def _(t):
    measures = {"quantity": "sum(quantity)", "cost": "round(sum(cost), 2)"}
    cond = all_of(any_of(Cond("region", "in", ["ASIA", "EUROPE"]), Cond("compartment", "=", "NATION_1")), Negate(Cond("quantity", "<", 3)))
    fixed = U.usage(usage_lines(t), "day", "1997-01-01", "1999-01-01", "month", ["region"], measures, cond)
    relative = U.usage(usage_lines(t), "day", "LAST_30_DAYS", None, "day", ["region"], measures, Cond("region", "=", "ASIA"), as_of="2000-01-01")
    return fixed.unionByName(relative)


@query(
    "u2_cost_forecast",
    """WITH s AS (SELECT o_orderpriority, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::BIGINT AS x, sum(o_totalprice) / 1000000 AS y FROM orders GROUP BY 1, 2),
       f AS (SELECT o_orderpriority, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, max(x) AS last FROM s GROUP BY 1)
       SELECT o_orderpriority, last + h AS x, round(b + a * (last + h), 6) AS forecast FROM f, range(1, 4) g(h)""",
)
def _(t):
    df = U.cost_forecast(t.orders, "o_orderdate", ["o_orderpriority"], "sum(o_totalprice) / 1000000", 3)
    return df.select("o_orderpriority", "x", F.round("forecast", 6).alias("forecast"))


@query(
    "u3_cost_table",
    f"""WITH {USAGE} SELECT region || '/' || compartment AS node, round(sum(cost) FILTER (WHERE year(day) = 1997), 2) AS cost_1997,
       round(sum(cost) FILTER (WHERE year(day) = 1998), 2) AS cost_1998 FROM u GROUP BY 1""",
)
def _(t):
    df = U.cost_table(usage_lines(t).withColumn("y", F.year("day")), "path", 2, "y", [1997, 1998], {"cost": "sum(cost)"})
    return df.select("node", F.round("1997_cost", 2).alias("cost_1997"), F.round("1998_cost", 2).alias("cost_1998"))


@query(
    "u4_carbon_estimate",
    f"""WITH {USAGE} SELECT region, round(sum(quantity * (0.1 + n_nationkey / 4.0)) FILTER (WHERE n_nationkey <> 7), 6) AS emission, round(sum(CASE WHEN n_nationkey = 7 THEN quantity ELSE 0 END), 6) AS unrated
       FROM u JOIN nation ON n_name = compartment GROUP BY 1""",
)
def _(t):
    # one compartment has no factor
    factors = t.nation.where("n_nationkey <> 7").select(F.col("n_name").alias("compartment"), F.expr("0.1D + n_nationkey / 4.0D").alias("factor"))
    sums = U.carbon(usage_lines(t), factors, ["compartment"], "quantity", ["region"])
    return sums.withColumns({c: F.round(c, 6) for c in ("emission", "unrated")})


@query(
    "u5_budget_alert",
    """WITH d AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderdate::DATE AS day, sum(o_totalprice) AS c FROM orders GROUP BY 1, 2, 3),
       r AS (SELECT *, sum(c) OVER (PARTITION BY o_orderpriority, month ORDER BY day ROWS UNBOUNDED PRECEDING) AS actual FROM d),
       b AS (SELECT o_orderpriority, sum(o_totalprice) / 80 AS budget FROM orders GROUP BY 1),
       p AS (SELECT o_orderpriority, month, day, round(actual * 100 / budget, 6) AS a, round(actual / day(day) * day(last_day(day)) * 100 / budget, 6) AS f FROM r JOIN b USING (o_orderpriority)),
       h AS (SELECT o_orderpriority, month, day, 'actual' AS kind, 50.0 AS threshold FROM p WHERE a >= 50 UNION ALL SELECT o_orderpriority, month, day, 'actual', 100.0 FROM p WHERE a >= 100
       UNION ALL SELECT o_orderpriority, month, day, 'forecast', 120.0 FROM p WHERE f >= 120)
       SELECT o_orderpriority, month, kind, threshold::DOUBLE AS threshold, min(day) AS first_day FROM h GROUP BY 1, 2, 3, 4""",
)
def _(t):
    budgets = t.orders.groupBy("o_orderpriority").agg((F.sum("o_totalprice") / 80).alias("budget"))
    rules = [("actual", 50.0), ("actual", 100.0), ("forecast", 120.0)]
    return U.budget_status(t.orders, budgets, "o_orderpriority", "o_orderdate", "o_totalprice", rules)


def gap_free(name, source, keys, key_list):
    return f"""{name} AS (SELECT {key_list}, bucket, coalesce(v, 0) AS v FROM (SELECT {key_list}, unnest(generate_series((SELECT min(bucket) FROM {source}),
 (SELECT max(bucket) FROM {source}), INTERVAL 1 DAY)) AS bucket FROM (SELECT DISTINCT {key_list} FROM {source})) LEFT JOIN {source} USING ({keys}, bucket))"""


ANOMALY = f"""{USAGE}, fine AS (SELECT region, compartment, day::TIMESTAMP AS bucket, sum(cost) AS v FROM u GROUP BY 1, 2, 3),
 tot AS (SELECT region, bucket, sum(v) AS v FROM fine GROUP BY 1, 2), {gap_free('t2', 'tot', 'region', 'region')}, {gap_free('f2', 'fine', 'region, compartment', 'region, compartment')},
 b AS (SELECT *, avg(v) OVER w AS mean, stddev_samp(v) OVER w AS sigma, count(v) OVER w AS n FROM t2 WINDOW w AS (PARTITION BY region ORDER BY bucket ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
 bad AS (SELECT * FROM b WHERE n = 28 AND round(abs(v - mean) - 3.0 * sigma, 9) > 0),
 g AS (SELECT region, compartment, bucket, round(v - avg(v) OVER (PARTITION BY region, compartment ORDER BY bucket ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 4) AS growth FROM f2),
 ca AS (SELECT bad.region, bad.bucket, bad.v AS cost, mean, compartment AS root_cause, growth, row_number() OVER (PARTITION BY bad.region, bad.bucket ORDER BY growth DESC, compartment) AS rn
 FROM bad JOIN g ON bad.region = g.region AND bad.bucket = g.bucket)"""


@query(
    "u6_cost_anomaly",
    f"WITH {ANOMALY} SELECT region, bucket, round(cost, 2) AS cost, round(mean, 6) AS mean, root_cause, growth FROM ca WHERE rn = 1",
)
def _(t):
    df = U.cost_anomalies(usage_lines(t), ["region"], "compartment", "day", "cost", 28, 3.0)
    return df.withColumns({"cost": F.round("cost", 2), "mean": F.round("mean", 6)})


@query(
    "u7_anomaly_analytics",
    f"""WITH {ANOMALY} SELECT region, count(*) AS anomalies, round(sum(cost - mean), 4) AS impact, min(bucket) AS "first", max(bucket) AS "last" FROM ca WHERE rn = 1 GROUP BY 1""",
)
def _(t):
    events = U.cost_anomalies(usage_lines(t), ["region"], "compartment", "day", "cost", 28, 3.0)
    return U.anomaly_summary(events, ["region"], "bucket", "cost", "mean").withColumn("impact", F.round("impact", 4))


@query(
    "u8_tiered_rating",
    """SELECT l_partkey, sum(l_quantity) AS quantity, round(least(sum(l_quantity), 100) * 1.0 + greatest(least(sum(l_quantity), 500) - 100, 0) * 0.8
       + greatest(sum(l_quantity) - 500, 0) * 0.5, 6) AS price FROM lineitem GROUP BY 1""",
)
def _(t):
    return U.rate(t.lineitem, ["l_partkey"], "l_quantity", [(0, 1.0), (100, 0.8), (500, 0.5)]).withColumn("price", F.round("price", 6))


@query(
    "u9_commitment_burn_down",
    """WITH m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::TIMESTAMP AS month, sum(o_totalprice) AS used FROM orders GROUP BY 1, 2),
       r AS (SELECT *, sum(used) OVER (PARTITION BY o_orderpriority ORDER BY month ROWS UNBOUNDED PRECEDING) AS s FROM m),
       c AS (SELECT o_orderpriority, sum(o_totalprice) / 2 AS commitment FROM orders GROUP BY 1), x AS (SELECT *, greatest(commitment - (s - used), 0) AS bal FROM r JOIN c USING (o_orderpriority))
       SELECT o_orderpriority, month, round(used, 2) AS used, round(least(used, bal), 1) AS covered, round(bal - least(used, bal), 1) AS balance, round(used - least(used, bal), 1) AS overage FROM x""",
)
def _(t):
    commitments = t.orders.groupBy("o_orderpriority").agg((F.sum("o_totalprice") / 2).alias("commitment"))
    df = U.burn_down(t.orders, commitments, "o_orderpriority", "o_orderdate", "o_totalprice")
    return df.withColumns({"used": F.round("used", 2), **{c: F.round(c, 1) for c in ("covered", "balance", "overage")}})


@query(
    "u10_limits_availability",
    """WITH us AS (SELECT s_nationkey AS place, count(*) AS used FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
       SELECT n_nationkey AS place, (2 + n_nationkey % 5)::BIGINT AS "limit", coalesce(used, 0) AS used, greatest(2 + n_nationkey % 5 - coalesce(used, 0), 0)::BIGINT AS free,
       round(coalesce(used, 0) * 100.0 / (2 + n_nationkey % 5), 6)::DOUBLE AS percent FROM nation LEFT JOIN us ON n_nationkey = place""",
)
def _(t):
    used = t.supplier.where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("place")).agg(F.count("*").alias("used"))
    limits = t.nation.select(F.col("n_nationkey").alias("place"), (2 + F.col("n_nationkey") % 5).cast("bigint").alias("limit"))
    return U.availability(used, limits, ["place"]).withColumn("percent", F.round("percent", 6))


@query(
    "u11_tree_rollup",
    """SELECT 'c' || c_custkey AS node, round(c_acctbal, 2) AS balance, 1::BIGINT AS customers FROM customer
       UNION ALL SELECT 'n' || c_nationkey, round(sum(c_acctbal), 2), count(*) FROM customer GROUP BY c_nationkey
       UNION ALL SELECT 'r' || n_regionkey, round(sum(c_acctbal), 2), count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey
       UNION ALL SELECT 'root', round(sum(c_acctbal), 2), count(*) FROM customer""",
)
def _(t):
    node = lambda mark, col: F.concat(F.lit(mark), F.col(col).cast("string"))
    values = t.customer.select(node("c", "c_custkey").alias("node"), F.col("c_acctbal").alias("balance"), F.lit(1).cast("bigint").alias("customers"))
    tree = (
        t.customer.select(node("c", "c_custkey").alias("node"), node("n", "c_nationkey").alias("parent"))
        .unionByName(t.nation.select(node("n", "n_nationkey").alias("node"), node("r", "n_regionkey").alias("parent")))
        .unionByName(t.region.select(node("r", "r_regionkey").alias("node"), F.lit("root").alias("parent")))
    )
    return U.tree_rollup(values, tree, ["balance", "customers"]).withColumn("balance", F.round("balance", 2))


@query(
    "u12_tag_coverage",
    """WITH e AS (SELECT event_type, json_extract_string(props, '$.k') AS k, CASE WHEN value > 50 THEN 'x' END AS owner FROM events)
       SELECT event_type, 'k' AS tag, count(k) AS tagged, count(*) - count(k) AS untagged FROM e GROUP BY 1
       UNION ALL SELECT event_type, 'owner', count(owner), count(*) - count(owner) FROM e GROUP BY 1
       UNION ALL SELECT event_type, 'team', 0, count(*) FROM e GROUP BY 1""",
)
def _(t):
    owner = F.when(F.col("value") > 50, F.create_map(F.lit("owner"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    tags = F.map_concat(F.from_json("props", "map<string,string>"), owner)
    return U.tag_report(t.events.withColumn("tags", tags), "tags", ["k", "owner", "team"], ["event_type"])


@query(
    "u13_billing_schedule",
    """SELECT l_returnflag, (date_trunc('month', l_shipdate) + to_months(i::INTEGER))::DATE AS invoice_month, round(sum(l_extendedprice / l_linenumber), 4) AS amount, count(*) AS lines
       FROM (SELECT *, unnest(range(0, l_linenumber)) AS i FROM lineitem) GROUP BY 1, 2""",
)
def _(t):
    df = U.billing_schedule(t.lineitem, "l_shipdate", "l_linenumber", "l_extendedprice", ["l_returnflag"])
    return df.withColumn("amount", F.round("amount", 4))
