"""Queries of the sensitive-data family."""

import pandas as pd
import secrets

from pyspark.sql import functions as F

from opsloom.catalog.logs import LINES, lines, sql_template
from opsloom.catalog.registry import query
from opsloom.operators import privacy as D
from opsloom.plans.predicates import Cond


def found(t):
    a = D.discover(t.documents).select(F.lit("documents").alias("table"), "*")
    return a.unionByName(D.discover(t.customer).select(F.lit("customer").alias("table"), "*"))


def discover_sql(table, cols):
    parts = []
    for c in cols:
        for name, (pattern, hint) in D.SENSITIVE.items():
            import re

            hit = "TRUE" if re.search(hint, c) else "FALSE"
            parts.append(
                f"""SELECT '{table}' AS "table", '{c}' AS "column", '{name}' AS type, count({c}) AS n, count(*) FILTER (WHERE regexp_matches({c}, '{pattern}')) AS hits,
                {hit} AS name_hit, round(count(*) FILTER (WHERE regexp_matches({c}, '{pattern}')) / count({c}), 6) AS share FROM {table}"""
            )
    return " UNION ALL ".join(parts)


FOUND = f"""SELECT * FROM ({discover_sql('documents', ['text', 'lang', 'source'])} UNION ALL {discover_sql('customer', ['c_name', 'c_mktsegment'])})
 WHERE hits > 0 OR name_hit"""


@query("d1_sensitive_discovery", FOUND)
def _(t):
    return found(t)


@query(
    "d2_discovery_analytics",
    f"""WITH f AS ({FOUND}) SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping("column") = 0 THEN 'column' ELSE 'total' END AS level, type, "column",
       count(DISTINCT "column") AS columns, sum(hits)::BIGINT AS hits, count(*) FILTER (WHERE name_hit) AS named FROM f GROUP BY GROUPING SETS ((type), ("column"), ())""",
)
def _(t):
    return D.discovery_summary(found(t))


@query("d3_fixed_and_null", "SELECT c_custkey, 'hidden' AS c_name, 0.0::DOUBLE AS c_acctbal, NULL::VARCHAR AS c_mktsegment FROM customer")
def _(t):
    df = D.mask(t.customer, "c_custkey", {"c_name": D.fixed("hidden"), "c_acctbal": D.fixed(0.0), "c_mktsegment": D.null_out()})
    return df.select("c_custkey", "c_name", "c_acctbal", F.col("c_mktsegment").cast("string").alias("c_mktsegment"))


@query("d4_delete_rows", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal < 0)")
def _(t):
    kept = D.delete_rows(t.customer, Cond("c_acctbal", "<", 0))
    return kept.unionByName(D.truncate(t.customer)).select("c_custkey", "c_acctbal")


@query(
    "d5_preserve_original",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name WHEN c_acctbal < 0 THEN 'debtor' ELSE c_name END AS c_name FROM customer",
)
def _(t):
    rules = [(Cond("c_mktsegment", "=", "BUILDING"), D.preserve()), (Cond("c_acctbal", "<", 0), D.fixed("debtor"))]
    return D.mask(t.customer, "c_custkey", {"c_name": rules}).select("c_custkey", "c_name")


def h(seed, key, n):
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT % {n})"


@query(
    "d6_random_values",
    f"""SELECT c_custkey, {h('n', 'c_custkey', 900)} + 100 AS number, round(({h('f', 'c_custkey', 100000)} + 500) / 100.0, 2)::DOUBLE AS dec,
       lpad({h('d', 'c_custkey', 1000000)}::VARCHAR, 6, '0') AS digits, substr(translate(md5('t|' || c_custkey), '0123456789abcdef', 'ghijklmnopqrstuv'), 1, 8) AS word,
       (DATE '2020-01-01' + {h('e', 'c_custkey', 1000)}::INTEGER)::DATE AS day FROM customer""",
)
def _(t):
    key = F.col("c_custkey")
    rows = t.customer.select(key, *[key.alias(c) for c in ("number", "dec", "digits", "word", "day")])
    df = D.mask(
        rows, "c_custkey",
        {
            "number": D.random_number("n", 100, 999), "dec": D.random_decimal("f", 5, 1005, 2), "digits": D.random_digits("d", 6),
            "word": D.random_string("t", 8), "day": D.random_date("e", "2020-01-01", 1000),
        },
    )
    return df.withColumn("dec", F.round("dec", 2))


@query(
    "d7_random_list_substitution",
    f"""SELECT c_custkey, (['alpha', 'beta', 'gamma'])[{h('l', 'c_custkey', 3)} + 1] AS c_mktsegment, n_name AS c_name
       FROM customer JOIN nation ON n_nationkey = {h('s', 'c_custkey', 25)}""",
)
def _(t):
    df = D.mask(t.customer, "c_custkey", {"c_mktsegment": D.random_list("l", ["alpha", "beta", "gamma"])})
    df = D.substitute(df, "c_custkey", "c_name", t.nation, "n_nationkey", "n_name", 25, "s")
    return df.select("c_custkey", "c_mktsegment", "c_name")


@query(
    "d8_shuffle",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('q-rows|' || c_custkey), c_custkey) AS p,
       row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('q-values|' || c_custkey), c_custkey) AS v,
       row_number() OVER (ORDER BY md5('g-rows|' || c_custkey), c_custkey) AS gp, row_number() OVER (ORDER BY md5('g-values|' || c_custkey), c_custkey) AS gv FROM customer)
       SELECT a.c_custkey, a.c_mktsegment, b.c_acctbal AS inside, g.c_acctbal AS anywhere FROM a JOIN a b ON a.c_mktsegment = b.c_mktsegment AND a.p = b.v JOIN a g ON a.gp = g.gv""",
)
def _(t):
    inside = D.shuffle(t.customer, "c_custkey", "c_acctbal", "q", ["c_mktsegment"])
    anywhere = D.shuffle(t.customer, "c_custkey", "c_acctbal", "g")
    left = inside.select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("inside"))
    return left.join(anywhere.select("c_custkey", F.col("c_acctbal").alias("anywhere")), "c_custkey")


@query(
    "d9_substring_regex_pattern",
    """SELECT c_custkey, substr(c_name, 1, 8) AS head, regexp_replace(c_name, '[0-9]{6}', '######') AS hidden,
       regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS shape FROM customer""",
)
def _(t):
    rows = t.customer.select("c_custkey", F.col("c_name").alias("head"), F.col("c_name").alias("hidden"), F.col("c_name").alias("shape"))
    return D.mask(
        rows, "c_custkey",
        {"head": D.keep_substring(1, 8), "hidden": D.replace_pattern("[0-9]{6}", "######"), "shape": D.character_pattern()},
    )


@query(
    "d10_expression_and_udf",
    """SELECT c_custkey, upper(c_mktsegment) || '-' || c_nationkey AS c_mktsegment, reverse(substr(c_name, 1, 12)) AS c_name FROM customer""",
)
def _(t):
    @F.pandas_udf("string")
    def backwards(s: pd.Series) -> pd.Series:
        return s.str[::-1]

    formats = {
        "c_mktsegment": D.sql_expression("upper(c_mktsegment) || '-' || c_nationkey"),
        "c_name": D.chained(D.keep_substring(1, 12), D.user_function(backwards)),
    }
    return D.mask(t.customer, "c_custkey", formats).select("c_custkey", "c_mktsegment", "c_name")


@query(
    "d11_format_library",
    f"""SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'x' WHEN c_acctbal > 5000 THEN substr(c_name, 1, 3) ELSE c_name END AS c_name,
       CASE WHEN c_acctbal > 5000 THEN {h('b', 'c_custkey', 100)}::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer""",
)
def _(t):
    library = {"blank": D.fixed("x"), "short": D.keep_substring(1, 3), "noise": lambda col, key: D.hash_number("b", key, 100).cast("double")}
    rich = Cond("c_acctbal", ">", 5000)
    policy = {"c_name": [(Cond("c_nationkey", "<", 5), "blank"), (rich, "short")], "c_acctbal": [(rich, "noise")]}
    return D.mask_with_library(t.customer, "c_custkey", library, policy).select("c_custkey", "c_name", "c_acctbal")


@query(
    "d12_masking_policy",
    """SELECT md5('k|' || c_custkey) AS customer, 'c' || c_nationkey AS c_name, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS total
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey""",
)
def _(t):
    out = D.mask_all(
        {"customer": t.customer, "orders": t.orders}, {"customer": "c_custkey", "orders": "o_orderkey"},
        {"customer": {"c_custkey": D.keyed_hash("k"), "c_name": D.sql_expression("'c' || c_nationkey")}},
        [D.Relation("customer", "c_custkey", "orders", "o_custkey")],
    )
    joined = out["customer"].join(out["orders"], F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy(F.col("c_custkey").alias("customer"), "c_name").agg(
        F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "d13_masking_report",
    """SELECT 'c_name' AS "column", count(*) AS rows, count(*) AS changed, 0::BIGINT AS nulled, 'OK' AS health FROM customer
       UNION ALL SELECT 'c_acctbal', count(*), count(*) FILTER (WHERE c_acctbal < 0), count(*) FILTER (WHERE c_acctbal < 0), 'NOT_IN_MODEL' FROM customer
       UNION ALL SELECT 'c_nationkey', count(*), 0, 0, 'OK' FROM customer UNION ALL SELECT 'c_mktsegment', count(*), 0, 0, 'NOT_MASKED' FROM customer""",
)
def _(t):
    after = D.mask(t.customer, "c_custkey", {"c_name": D.fixed("x"), "c_acctbal": [(Cond("c_acctbal", "<", 0), D.null_out())]})
    return D.masking_report(t.customer, after, "c_custkey", ["c_name", "c_acctbal"], ["c_name", "c_mktsegment"])


@query(
    "d14_column_encryption",
    """SELECT c_custkey, c_name, c_acctbal, (length(c_name) + 16)::INTEGER AS payload_bytes, 12 AS iv_bytes, 'AES_256_GCM_IV12_TAG16' AS algorithm FROM customer""",
)
def _(t):
    """With the key of the session, or one made up for this run, which nothing keeps."""
    named = t.spark.conf.get("spark.opsloom.encryption.key", None)
    key = named.encode() if named else secrets.token_bytes(D.KEY_BYTES)
    sealed = D.encrypt(t.customer.withColumn("plain", F.col("c_name")), ["c_name", "c_acctbal"], key, "key-1", "customer")
    sealed = sealed.withColumns(
        {"payload_bytes": F.length("c_name.payload"), "iv_bytes": F.length("c_name.header.iv"), "algorithm": F.col("c_name.header.algorithm")}
    )
    opened = D.decrypt(sealed, ["c_name", "c_acctbal"], key)
    return opened.select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "payload_bytes", "iv_bytes", "algorithm")


@query("d15_content_digest", "SELECT doc_id, md5(length(text) || '=' || text || '|' || length(lang) || '=' || lang || '|' || length(n_chars::VARCHAR) || '=' || n_chars) AS digest FROM documents")
def _(t):
    return D.digest(t.documents, ["text", "lang", "n_chars"]).select("doc_id", "digest")


@query(
    "d16_audit_summary",
    """WITH e AS (SELECT date_trunc('day', ts)::TIMESTAMP AS period, event_type FROM events)
       SELECT CASE WHEN grouping(period) = 1 THEN 'total' WHEN grouping(event_type) = 1 THEN 'period' ELSE 'period,event_type' END AS level, period, event_type, count(*) AS events
       FROM e GROUP BY GROUPING SETS ((period), (period, event_type), ())""",
)
def _(t):
    return D.audit_summary(t.events, ["event_type"], "ts", "day")


@query(
    "d17_before_after_state",
    """WITH s AS (SELECT *, json_extract_string(props, '$.k') AS k, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind, event_type IN ('error', 'click') AS hot FROM events),
       p AS (SELECT *, lag(event_id) OVER w AS pid, lag(k) OVER w AS pk, lag(kind) OVER w AS pkind, lag(hot) OVER w AS phot FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, concat_ws(',', CASE WHEN hot AND NOT phot THEN 'hot' END, CASE WHEN kind IS NOT NULL AND pkind IS NULL THEN 'kind' END) AS added,
       concat_ws(',', CASE WHEN phot AND NOT hot THEN 'hot' END, CASE WHEN kind IS NULL AND pkind IS NOT NULL THEN 'kind' END) AS removed,
       concat_ws(',', CASE WHEN k <> pk THEN 'k' END, CASE WHEN kind <> pkind THEN 'kind' END) AS changed FROM p WHERE pid IS NOT NULL""",
)
def _(t):
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    hot = F.when(F.col("event_type").isin("error", "click"), F.lit("1"))
    state = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), kind.alias("kind"), hot.alias("hot")))
    df = D.state_diff(t.events.withColumn("state", state), ["user_id"], ["ts", "event_id"], "state", F.date_trunc("hour", "ts"))
    return df.select("event_id", "added", "removed", "changed")


@query(
    "d18_baseline_drift",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN quality = 0 AND doc_id % 3 = 0 THEN 'changed' END AS status,
       CASE WHEN doc_id % 10 <> 0 AND quality = 0 AND doc_id % 3 = 0 THEN 'quality' END AS changed_columns FROM labels WHERE doc_id % 10 = 0 OR (quality = 0 AND doc_id % 3 = 0)
       UNION ALL SELECT -1 - doc_id, 'fixed', NULL FROM labels WHERE toxic = 1""",
)
def _(t):
    old = t.labels.where("doc_id % 10 <> 0").withColumn("quality", F.expr("CASE WHEN quality = 0 AND doc_id % 3 = 0 THEN 1 ELSE quality END").cast("int"))
    gone = t.labels.where("toxic = 1").withColumn("doc_id", -1 - F.col("doc_id"))
    kinds = {c: F.col(c).cast("int") for c in ("quality", "toxic")}
    return D.baseline_diff(t.labels.withColumns(kinds), old.unionByName(gone).withColumns(kinds), ["doc_id"])


GRANTS = """SELECT 'u' || c_custkey AS grantee, 'n' || c_nationkey AS granted FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
 UNION SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 1) FROM nation WHERE n_nationkey % 4 = 0 UNION SELECT 'r' || r_regionkey, 'ADMIN' FROM region WHERE r_regionkey < 3
 UNION SELECT 'r3', 'n1'"""


@query(
    "d19_grant_paths",
    f"""WITH RECURSIVE g AS ({GRANTS}), p AS (SELECT grantee AS head, [grantee, granted] AS path FROM g WHERE granted = 'ADMIN'
       UNION ALL SELECT g.grantee, list_prepend(g.grantee, path) FROM p JOIN g ON g.granted = p.head WHERE NOT list_contains(path, g.grantee))
       SELECT head AS user, array_to_string(path, ' > ') AS chain, (len(path) - 1)::INTEGER AS steps FROM p WHERE head LIKE 'u%'""",
)
def _(t):
    text = lambda mark, col: F.concat(F.lit(mark), F.col(col).cast("string"))
    pair = lambda df, a, b: df.select(a.alias("grantee"), b.alias("granted"))
    grants = (
        pair(t.customer, text("u", "c_custkey"), text("n", "c_nationkey"))
        .unionByName(pair(t.nation, text("n", "n_nationkey"), text("r", "n_regionkey")))
        .unionByName(pair(t.nation.where("n_nationkey % 4 = 0"), text("n", "n_nationkey"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string"))))
        .unionByName(pair(t.region.where("r_regionkey < 3"), text("r", "r_regionkey"), F.lit("ADMIN")))
        .unionByName(pair(t.region.where("r_regionkey = 3"), F.lit("r3"), F.lit("n1")))
    )
    return D.grant_paths(grants, t.customer.select(text("u", "c_custkey").alias("user")), "ADMIN")


@query(
    "d20_statement_violations",
    f"""WITH l AS (SELECT doc_id, line, {sql_template('line')} AS statement FROM ({LINES}))
       SELECT statement, count(*) AS n, min(line) AS example FROM l WHERE statement NOT IN (SELECT statement FROM l WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) GROUP BY 1""",
)
def _(t):
    log = lines(t)
    allowed = log.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return D.violations(log, allowed, "line")


@query(
    "d21_user_risk_profile",
    """WITH r AS (SELECT user_id AS "user", count(DISTINCT event_type) AS roles FROM events WHERE value > 100 GROUP BY 1),
       l AS (SELECT user_id AS "user", count(*) AS logins, count(*) FILTER (WHERE event_type = 'error') AS failures, min(date_diff('day', ts::DATE, DATE '2024-01-31'))::INTEGER AS idle_days FROM events WHERE event_type <> 'view' GROUP BY 1),
       j AS (SELECT c_custkey AS "user", coalesce(roles, 0) AS roles, coalesce(logins, 0) AS logins, coalesce(failures, 0) AS failures, idle_days FROM customer LEFT JOIN r ON c_custkey = r."user" LEFT JOIN l ON c_custkey = l."user"),
       s AS (SELECT *, CASE WHEN roles > 4 THEN 2 ELSE 0 END + CASE WHEN failures > 13 THEN 2 ELSE 0 END + CASE WHEN idle_days IS NULL OR idle_days > 1 THEN 1 ELSE 0 END AS score FROM j)
       SELECT *, CASE WHEN score >= 4 THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM s""",
)
def _(t):
    users = t.customer.select(F.col("c_custkey").alias("user"))
    grants = t.events.where("value > 100").select(F.col("user_id").alias("user"), F.col("event_type").alias("role"))
    logins = t.events.where("event_type <> 'view'").select(
        F.col("user_id").alias("user"), F.datediff(F.lit("2024-01-31"), F.to_date("ts")).alias("day_age"), (F.col("event_type") == "error").alias("failed")
    )
    return D.user_profile(users, grants, logins, {"roles": 4, "failures": 13, "idle": 1})
