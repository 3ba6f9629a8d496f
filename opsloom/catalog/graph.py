"""Queries of the lineage and posture family."""

from pyspark.sql import functions as F

from opsloom.catalog.registry import query
from opsloom.operators import graph as C
from opsloom.operators import versions as V
from opsloom.plans.predicates import Cond, Negate, all_of, any_of


def named(mark, col):
    return F.concat(F.lit(mark), F.col(col).cast("string"))


EDGES = """edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
 UNION SELECT 'c0', 'r1' UNION SELECT 'n3', 'r0')"""


def edges(t):
    a = t.nation.select(named("r", "n_regionkey").alias("src"), named("n", "n_nationkey").alias("dst"))
    b = t.customer.select(named("n", "c_nationkey").alias("src"), named("c", "c_custkey").alias("dst"))
    loop = t.spark.createDataFrame([("c0", "r1"), ("n3", "r0")], "src string, dst string")
    return a.unionByName(b).unionByName(loop)


@query(
    "c1_lineage_closure",
    f"""WITH RECURSIVE {EDGES}, d(start, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT start, dst, depth + 1 FROM d JOIN edges ON node = src WHERE depth < 12),
       u(start, node, depth) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer UNION SELECT start, src, depth + 1 FROM u JOIN edges ON node = dst WHERE depth < 12)
       SELECT 'down' AS way, start, node, min(depth) AS depth FROM d GROUP BY 2, 3 HAVING min(depth) > 0 UNION ALL SELECT 'up', start, node, min(depth) FROM u GROUP BY 2, 3 HAVING min(depth) > 0""",
)
def _(t):
    down = C.lineage(edges(t), t.region.select(named("r", "r_regionkey").alias("start")))
    up = C.lineage(edges(t), t.customer.select(named("c", "c_custkey").alias("start")), "upstream")
    return down.select(F.lit("down").alias("way"), "*").unionByName(up.select(F.lit("up").alias("way"), "*"))


@query(
    "c2_glossary_tree",
    """WITH t AS (SELECT 'part' || p_partkey AS node, p_type || '/' || p_brand AS parent FROM part UNION ALL SELECT DISTINCT p_type || '/' || p_brand, p_type FROM part
       UNION ALL SELECT DISTINCT p_type, 'all' FROM part UNION ALL SELECT 'all', NULL), k AS (SELECT parent AS node, count(*) AS children FROM t WHERE parent IS NOT NULL GROUP BY 1)
       SELECT node, 0::BIGINT AS children, 0::BIGINT AS descendants FROM t WHERE node LIKE 'part%' AND node NOT IN (SELECT node FROM k)
       UNION ALL SELECT p_type || '/' || p_brand, count(*), count(*) FROM part GROUP BY 1
       UNION ALL SELECT p_type, count(DISTINCT p_brand), count(*) + count(DISTINCT p_brand) FROM part GROUP BY 1
       UNION ALL SELECT 'all', count(DISTINCT p_type), count(*) + count(DISTINCT p_type || '/' || p_brand) + count(DISTINCT p_type) FROM part""",
)
def _(t):
    brand = F.concat_ws("/", "p_type", "p_brand")
    terms = (
        t.part.select(named("part", "p_partkey").alias("node"), brand.alias("parent"))
        .unionByName(t.part.select(brand.alias("node"), F.col("p_type").alias("parent")).distinct())
        .unionByName(t.part.select(F.col("p_type").alias("node"), F.lit("all").alias("parent")).distinct())
        .unionByName(t.spark.sql("SELECT 'all' AS node, CAST(NULL AS STRING) AS parent"))
    )
    return C.glossary_tree(terms)


@query(
    "c3_term_suggestion",
    """(SELECT 'prefix' AS kind, p_name, count(*) AS n FROM part WHERE starts_with(lower(p_name), 'r') GROUP BY 2 ORDER BY n DESC, p_name LIMIT 7)
       UNION ALL (SELECT 'edits', p_name, count(*) AS n FROM part WHERE levenshtein(lower(p_name), 'red rings') <= 4 GROUP BY 2 ORDER BY n DESC, p_name LIMIT 7)""",
)
def _(t):
    near = C.suggest(t.part, "p_name", "red rings", 7, max_edits=4).select(F.lit("edits").alias("kind"), "p_name", "n")
    return C.suggest(t.part, "p_name", "R", 7).select(F.lit("prefix").alias("kind"), "p_name", "n").unionByName(near)


DEPS = """deps AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || p_partkey, 'p' || (p_partkey // 2) FROM part WHERE p_partkey > 0),
 adv AS (SELECT 'p' || p_partkey AS component, '1.5' AS low, '2.' || (10 + p_partkey % 30) AS high, p_size / 5.0 AS score, 'A' || (p_partkey % 10) AS advisory FROM part WHERE p_type = 'SMALL' AND p_size > 40),
 ver AS (SELECT 'p' || p_partkey AS component, (1 + p_partkey % 3) || '.' || p_size AS version FROM part)"""


def version_sql(col):
    return f"list_transform(string_split({col}, '.'), lambda x: x::INTEGER)"


@query(
    "c4_vulnerability_audit",
    f"""WITH RECURSIVE {DEPS}, own AS (SELECT component AS node, max(score) AS score FROM ver JOIN adv USING (component) WHERE advisory <> 'A7' AND {version_sql('version')} >= {version_sql('low')}
       AND {version_sql('version')} < {version_sql('high')} GROUP BY 1), r(node, score) AS (SELECT node, score FROM own UNION SELECT src, score FROM r JOIN deps ON node = dst)
       SELECT node, max(score)::DOUBLE AS score FROM r GROUP BY 1""",
)
def _(t):
    a = t.lineitem.select(named("o", "l_orderkey").alias("src"), named("p", "l_partkey").alias("dst"))
    b = t.part.where("p_partkey > 0").select(named("p", "p_partkey").alias("src"), F.expr("concat('p', p_partkey div 2)").alias("dst"))
    adv = t.part.where("p_type = 'SMALL' AND p_size > 40").select(
        named("p", "p_partkey").alias("component"), F.lit("1.5").alias("low"), F.expr("concat('2.', 10 + p_partkey % 30)").alias("high"),
        F.expr("p_size / 5.0D").alias("score"), F.expr("concat('A', p_partkey % 10)").alias("advisory"),
    )
    ver = t.part.select(named("p", "p_partkey").alias("component"), F.expr("concat(1 + p_partkey % 3, '.', p_size)").alias("version"))
    return C.vulnerability_audit(a.unionByName(b), ver, adv, ["A7"])


@query(
    "c5_upgrade_recommendation",
    f"""WITH v AS (SELECT DISTINCT p_brand AS component, (1 + p_size % 4) || '.' || p_size AS version FROM part), adv AS (SELECT DISTINCT p_brand AS component, '1.0' AS low, '2.' || (5 + length(p_brand)) AS high FROM part
       UNION SELECT p_brand, '3.20', '4.0' FROM part WHERE p_size = 7),
       dirty AS (SELECT DISTINCT component, version FROM v JOIN adv USING (component) WHERE {version_sql('version')} >= {version_sql('low')} AND {version_sql('version')} < {version_sql('high')}),
       clean AS (SELECT * FROM v EXCEPT SELECT * FROM dirty)
       SELECT d.component, d.version, arg_min(c.version, {version_sql('c.version')}) FILTER (WHERE {version_sql('c.version')} > {version_sql('d.version')}) AS upgrade FROM dirty d LEFT JOIN clean c ON d.component = c.component GROUP BY 1, 2""",
)
def _(t):
    v = t.part.select(F.col("p_brand").alias("component"), F.expr("concat(1 + p_size % 4, '.', p_size)").alias("version")).distinct()
    adv = t.part.select(F.col("p_brand").alias("component"), F.lit("1.0").alias("low"), F.expr("concat('2.', 5 + length(p_brand))").alias("high"))
    more = t.part.where("p_size = 7").select(F.col("p_brand").alias("component"), F.lit("3.20").alias("low"), F.lit("4.0").alias("high"))
    return V.recommend_upgrades(v, v, adv.unionByName(more).distinct())


@query(
    "c6_condition_groups",
    """SELECT o_orderkey FROM orders WHERE (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000) AND o_orderstatus = 'F')
       OR (o_totalprice > 400000 AND NOT (o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000)))""",
)
def _(t):
    rich = t.customer.where("c_acctbal > 8000").select("c_custkey")
    member = Cond("o_custkey", "member", "rich")
    tree = any_of(
        all_of(member, Cond("o_orderstatus", "=", "F")),
        all_of(Cond("o_totalprice", ">", 400000), Negate(any_of(Cond("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), member))),
    )
    return C.match_conditions(t.orders, tree, {"rich": rich}).select("o_orderkey")


@query(
    "c7_problem_trend",
    """WITH e AS (SELECT date_trunc('week', ts)::TIMESTAMP AS period, (user_id % 4)::BIGINT AS team FROM events WHERE event_type = 'error'),
       c AS (SELECT CASE WHEN grouping(team) = 1 THEN 'period' ELSE 'period,team' END AS level, period, team, count(*) AS n FROM e GROUP BY GROUPING SETS ((period), (period, team))),
       p AS (SELECT unnest(generate_series((SELECT min(period) FROM c), (SELECT max(period) FROM c), INTERVAL 7 DAY)) AS period),
       f AS (SELECT g.level, p.period, g.team, coalesce(c.n, 0) AS n FROM p CROSS JOIN (SELECT DISTINCT level, team FROM c) g
       LEFT JOIN c ON c.level = g.level AND c.period = p.period AND c.team IS NOT DISTINCT FROM g.team)
       SELECT *, n - lag(n) OVER (PARTITION BY level, team ORDER BY period) AS change FROM f""",
)
def _(t):
    errors = t.events.where("event_type = 'error'").withColumn("team", F.col("user_id") % 4)
    return C.problems(errors, ["team"], "ts", "week")


@query(
    "c8_risk_score",
    """WITH r AS (SELECT user_id, sum(CASE event_type WHEN 'error' THEN 5.0 WHEN 'purchase' THEN 2.0 ELSE 0.0 END::DOUBLE * exp(-(date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-02-01') // 1) / 86400.0 * 0.6931471805599453 / 7)) AS score FROM events GROUP BY 1)
       SELECT user_id, round(score, 3) AS score, round(score / (SELECT sum(score) FROM r), 5) AS share FROM r""",
)
def _(t):
    rows = t.events.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    df = C.risk_score(rows, "user_id", "event_type", "ts", {"error": 5.0, "purchase": 2.0}, "2024-02-01", 7)
    return df.select("user_id", F.round("score", 3).alias("score"), F.round("share", 5).alias("share"))


@query(
    "c9_attribute_masking",
    """SELECT c_custkey, CASE WHEN c_nationkey = 1 OR c_acctbal < 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer""",
)
def _(t):
    rules = [(Cond("c_nationkey", "=", 1), ["c_name"]), (Cond("c_acctbal", "<", 0), ["c_name", "c_acctbal"])]
    return C.data_mask(t.customer, rules).select("c_custkey", "c_name", "c_acctbal")


@query(
    "c10_asset_inventory",
    """SELECT 'part' AS kind, p_type AS grp, count(*) AS n, round(sum(p_retailprice), 2) AS worth FROM part GROUP BY 2
       UNION ALL SELECT 'supplier', n_name, count(*), round(sum(s_acctbal), 2) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 2""",
)
def _(t):
    parts = C.inventory(t.part, ["p_type"], {"n": "count(*)", "worth": "round(sum(p_retailprice), 2)"})
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    suppliers = C.inventory(suppliers, ["n_name"], {"n": "count(*)", "worth": "round(sum(s_acctbal), 2)"})
    return parts.select(F.lit("part").alias("kind"), F.col("p_type").alias("grp"), "n", "worth").unionByName(
        suppliers.select(F.lit("supplier").alias("kind"), F.col("n_name").alias("grp"), "n", "worth")
    )


@query(
    "c11_level_recommendation",
    """WITH m AS (SELECT l_partkey, round(avg(l_quantity), 6) AS use, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY 1)
       SELECT l_partkey, use, CASE WHEN use <= 22 THEN 'low' ELSE 'middle' END AS level, CASE WHEN use <= 22 THEN 'stop' ELSE 'shrink' END AS advice,
       round(cost * CASE WHEN use <= 22 THEN 0.9 ELSE 0.25 END, 4)::DOUBLE AS saving FROM m WHERE use <= 25""",
)
def _(t):
    m = t.lineitem.groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("use"), F.round(F.sum("l_extendedprice"), 2).alias("cost"))
    df = C.recommend_actions(m, "l_partkey", "use", "cost", [("low", 22.0, "stop", 0.9), ("middle", 25.0, "shrink", 0.25)])
    return df.withColumn("saving", F.round("saving", 4))
