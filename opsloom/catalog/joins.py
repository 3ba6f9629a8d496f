"""Queries of the join and lookup family."""

from pyspark.sql import functions as F

from opsloom.catalog.registry import query
from opsloom.operators import joins as J
from opsloom.operators import matching as MA


@query(
    "j1_join",
    """SELECT 'inner' AS how, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders
       ON c_custkey = o_custkey GROUP BY c_mktsegment
       UNION ALL SELECT 'left', c_mktsegment, count(*), round(sum(o_totalprice), 2) FROM customer LEFT JOIN orders
       ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY c_mktsegment
       UNION ALL SELECT 'full', c_mktsegment, count(*), round(sum(o_totalprice), 2) FROM customer FULL JOIN
       (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey GROUP BY c_mktsegment""",
)
def _(t):
    on = F.col("c_custkey") == F.col("o_custkey")
    parts = {
        "inner": J.join(t.customer, t.orders, on),
        "left": J.join(t.customer, t.orders, on & (F.col("o_totalprice") > 400000), "left"),
        "full": J.join(t.customer, t.orders.where("o_orderstatus = 'P'"), on, "full"),
    }
    out = None
    for how, df in parts.items():
        df = df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        df = df.select(F.lit(how).alias("how"), "*")
        out = df if out is None else out.unionByName(df)
    return out


@query(
    "j2_lookup",
    """WITH ref AS (SELECT s_nationkey AS c_nationkey, arg_min(s_name, s_suppkey) AS s_name, arg_min(s_acctbal, s_suppkey) AS s_acctbal
       FROM supplier WHERE s_acctbal > 3000 GROUP BY s_nationkey)
       SELECT c_custkey, coalesce(s_name, 'none') AS s_name, s_acctbal FROM customer LEFT JOIN ref USING (c_nationkey)""",
)
def _(t):
    ref = t.supplier.where("s_acctbal > 3000").withColumnRenamed("s_nationkey", "c_nationkey")
    out = J.lookup(t.customer, ref, ["c_nationkey"], ["s_name", "s_acctbal"], "first", ["s_suppkey"], {"s_name": "none"})
    return out.select("c_custkey", "s_name", "s_acctbal")


@query(
    "j3_lookup_match_kinds",
    """WITH names AS (SELECT 'Customer#0000' || lpad((n_nationkey * 4)::VARCHAR, 3, '0') || '*' AS pattern, n_nationkey FROM nation),
       nets AS (SELECT '10.' || n_nationkey || '.' || '0.0/16' AS net, n_nationkey FROM nation)
       SELECT c_custkey, (SELECT min(n_nationkey) FROM names WHERE c_name LIKE replace(pattern, '*', '%')) AS by_pattern,
       CASE WHEN c_custkey % 30 < 25 THEN (c_custkey % 30)::INTEGER END AS by_net, n.n_nationkey AS by_case
       FROM customer LEFT JOIN nation n ON n.n_name = 'NATION_' || (c_custkey % 40)""",
)
def _(t):
    patterns = t.nation.select(
        F.concat(F.lit("Customer#0000"), F.lpad((F.col("n_nationkey") * 4).cast("string"), 3, "0"), F.lit("*")).alias("pattern"),
        F.col("n_nationkey").alias("by_pattern"), "n_nationkey",
    )
    nets = t.nation.select(
        F.concat(F.lit("10."), F.col("n_nationkey").cast("string"), F.lit(".0.0/16")).alias("net"),
        F.col("n_nationkey").alias("by_net"), "n_nationkey",
    )
    names = t.nation.select("n_name", F.col("n_nationkey").alias("by_case"), "n_nationkey")
    rows = t.customer.select(
        "c_custkey", "c_name",
        F.concat(F.lit("10."), (F.col("c_custkey") % 30).cast("string"), F.lit(".7."), (F.col("c_custkey") % 250).cast("string")).alias("ip"),
        F.concat(F.lit("Nation_"), (F.col("c_custkey") % 40).cast("string")).alias("place"),
    )
    rows = MA.lookup_match(rows, patterns, "c_name", "pattern", "wildcard", ["by_pattern"], "n_nationkey")
    rows = MA.lookup_match(rows, nets, "ip", "net", "cidr", ["by_net"], "n_nationkey")
    rows = MA.lookup_match(rows, names, "place", "n_name", "nocase", ["by_case"], "n_nationkey")
    return rows.select("c_custkey", "by_pattern", "by_net", "by_case")


@query(
    "j3_lookup_wildcards",
    """WITH pats AS (SELECT '*.' || n_nationkey || '7' AS pattern, n_nationkey AS o FROM nation UNION ALL SELECT '*#0000?' || n_nationkey || '*', 30 + n_nationkey FROM nation
       UNION ALL SELECT 'S*' || chr((65 + n_nationkey)::INTEGER) || '?*', 60 + n_nationkey FROM nation UNION ALL SELECT '*', 1000),
       v AS (SELECT 'c' || c_custkey AS id, c_name || '.' || (c_custkey % 400) AS name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier),
       m AS (SELECT id, min(o) AS o FROM v, pats WHERE regexp_full_match(name, replace(replace(replace(pattern, '.', '[.]'), '*', '.*'), '?', '.')) GROUP BY 1)
       SELECT id, o::BIGINT AS o FROM m""",
)
def _(t):
    """Patterns with a wildcard in front, in the middle and alone."""
    key = F.col("n_nationkey")
    kinds = [
        (F.concat(F.lit("*."), key.cast("string"), F.lit("7")), key), (F.concat(F.lit("*#0000?"), key.cast("string"), F.lit("*")), key + 30),
        (F.concat(F.lit("S*"), F.char(key + 65), F.lit("?*")), key + 60),
    ]
    pats = t.nation.select(F.inline(F.array(*[F.struct(p.alias("pattern"), o.cast("bigint").alias("o")) for p, o in kinds])))
    pats = pats.unionByName(t.nation.select(F.lit("*").alias("pattern"), F.lit(1000).cast("bigint").alias("o")).distinct())
    names = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat("c_name", F.lit("."), (F.col("c_custkey") % 400).cast("string")).alias("name"))
    names = names.unionByName(t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name")))
    return MA.lookup_match(names, pats, "name", "pattern", "wildcard", ["o"], "o").select("id", "o")


@query(
    "j4_map_rows",
    """SELECT o_orderkey, lines, qty FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS qty
       FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey""",
)
def _(t):
    other = t.lineitem.where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.map_rows(t.orders, other, ["o_orderkey"], {"lines": "count(*)", "qty": "sum(l_quantity)"}).select("o_orderkey", "lines", "qty")


@query(
    "j5_foreign_key_check",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN
       (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW')""",
)
def _(t):
    parent = t.orders.where("o_orderpriority <> '5-LOW'")
    return J.orphans(t.lineitem, parent, ["l_orderkey"], ["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("j6_unique_key_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return J.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "j7_period_comparison",
    """WITH a AS (SELECT o_orderpriority, count(*) FILTER (WHERE y = 1998) AS orders_now, count(*) FILTER (WHERE y = 1997) AS orders_then,
       round(sum(o_totalprice) FILTER (WHERE y = 1998), 2) AS total_now, round(sum(o_totalprice) FILTER (WHERE y = 1997), 2) AS total_then
       FROM (SELECT *, year(o_orderdate) AS y FROM orders) WHERE y IN (1997, 1998) GROUP BY 1)
       SELECT *, orders_now - orders_then AS orders_diff, round((orders_now - orders_then) * 100.0 / orders_then, 6)::DOUBLE AS orders_pct,
       round(total_now - total_then, 2) AS total_diff, round((total_now - total_then) * 100.0 / total_then, 6)::DOUBLE AS total_pct FROM a""",
)
def _(t):
    df = J.compare_periods(
        t.orders, "o_orderdate", ["o_orderpriority"], {"orders": "count(*)", "total": "sum(o_totalprice)"},
        "1998-01-01", "1999-01-01", "1 YEAR",
    )
    two = [F.round(c, 2).alias(c) for c in ("total_now", "total_then", "total_diff")]
    six = [F.round(c, 6).alias(c) for c in ("orders_pct", "total_pct")]
    return df.select("o_orderpriority", "orders_now", "orders_then", "orders_diff", *two, *six)


@query(
    "j8_content_compare",
    """WITH b AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 11 <> 0
       UNION ALL SELECT -1 - c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 13 = 0)
       SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey,
       CASE WHEN b.c_custkey IS NULL THEN 'only_left' WHEN a.c_custkey IS NULL THEN 'only_right' ELSE 'changed' END AS status,
       CASE WHEN a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL THEN concat_ws(',',
       CASE WHEN a.c_acctbal IS DISTINCT FROM b.c_acctbal THEN 'c_acctbal' END,
       CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'c_mktsegment' END) END AS changed_columns
       FROM customer a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL
       OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""",
)
def _(t):
    kept = t.customer.where("c_custkey % 11 <> 0").withColumns(
        {
            "c_acctbal": F.expr("CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END"),
            "c_mktsegment": F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END"),
        }
    )
    new = t.customer.where("c_custkey % 13 = 0").withColumn("c_custkey", -1 - F.col("c_custkey"))
    return J.compare_tables(t.customer, kept.unionByName(new), ["c_custkey"])


WINDOWS = """SELECT o_orderkey AS win, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey * 37 % 43200) AS s,
 TIMESTAMP '2024-01-01' + to_minutes(o_orderkey * 37 % 43200 + 20 + o_orderkey % 100) AS e FROM orders WHERE o_orderpriority = '1-URGENT'"""


def windows(t):
    """Time windows derived from the urgent orders."""
    begin = F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, o_orderkey * 37 % 43200)")
    end = F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, o_orderkey * 37 % 43200 + 20 + o_orderkey % 100)")
    return t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("win"), begin.alias("s"), end.alias("e"))


@query(
    "j9_interval_join",
    f"""SELECT win, count(*) AS n, round(sum(value), 2) AS total FROM events JOIN ({WINDOWS}) ON ts >= s AND ts < e GROUP BY win""",
)
def _(t):
    hit = J.in_interval(
        t.events.select("event_id", "ts", "value"), windows(t), "ts", "s", "e", 3600, salts=4, key=["event_id"], per=["win"], count="n", totals={"total": "value"}
    )
    return hit.select("win", "n", F.round("total", 2).alias("total"))


@query(
    "j10_indicator_match",
    """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host,
       lower(regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1)) AS section FROM pages),
       ioc AS (SELECT DISTINCT host AS value, CASE WHEN starts_with(host, 'm.') THEN 'mobile' ELSE 'org' END AS threat FROM h
       WHERE starts_with(host, 'm.') OR host LIKE '%.org' UNION SELECT 'fr', 'region')
       SELECT page_id, 'host' AS field, value, threat FROM h JOIN ioc ON host = value
       UNION ALL SELECT page_id, 'section', value, threat FROM h JOIN ioc ON section = value""",
)
def _(t):
    pages = t.pages.select(
        "page_id",
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1).alias("section"),
    )
    hosts = pages.where("startswith(host, 'm.') OR host LIKE '%.org'").select(
        F.col("host").alias("indicator"), F.expr("CASE WHEN startswith(host, 'm.') THEN 'mobile' ELSE 'org' END").alias("threat")
    )
    iocs = hosts.unionByName(t.spark.createDataFrame([("FR", "region")], "indicator string, threat string"))
    return J.match_indicators(pages, iocs, ["page_id"], ["host", "section"])


@query(
    "j11_staff_star",
    """WITH r AS (SELECT e.c_custkey AS employee_id, e.c_name AS name, n_name AS job_title, r_name AS department_name,
       m.c_name AS manager_name, e.c_acctbal AS salary, row_number() OVER (PARTITION BY r_name ORDER BY e.c_acctbal DESC, e.c_custkey) AS rank
       FROM customer e JOIN nation ON e.c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN customer m ON m.c_custkey = CASE WHEN e.c_custkey > 0 THEN e.c_custkey // 10 END)
       SELECT employee_id, name, job_title, department_name, manager_name, salary, rank::INTEGER AS rank FROM r WHERE rank <= 5""",
)
def _(t):
    departments = t.region.select(F.col("r_regionkey").alias("department_id"), F.col("r_name").alias("department_name"))
    jobs = t.nation.select(
        F.col("n_nationkey").alias("job_id"), F.col("n_name").alias("job_title"), F.col("n_regionkey").alias("department_id")
    )
    staff = t.customer.select(
        F.col("c_custkey").alias("employee_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("job_id"),
        F.col("c_acctbal").alias("salary"), F.expr("CASE WHEN c_custkey > 0 THEN c_custkey div 10 END").alias("manager_id"),
    )
    top = J.top_staff(J.staff_report(departments, jobs, staff))
    return top.select("employee_id", "name", "job_title", "department_name", "manager_name", "salary", "rank")
