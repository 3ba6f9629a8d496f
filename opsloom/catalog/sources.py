"""Queries of the source, sink and merge family."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.catalog.registry import query
from opsloom.plans.storage import shared_path
from opsloom.sources import entities as E
from opsloom.sources import inventory as I
from opsloom.sources import merging as M


@query("s1_csv_entity", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = shared_path(t.spark, "csv")
    opts = {"sep": ";", "quote": "'", "escape": "\\"}
    E.write_entity(t.customer, path, "csv", **opts)
    return E.read_entity(t.spark, path, "csv", t.customer.schema, **opts)


@query(
    "s2_json_entity",
    "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type || chr(9) || 'x' AS note FROM events",
)
def _(t):
    path = shared_path(t.spark, "json")
    k = F.get_json_object("props", "$.k")
    line = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "k": '), k, F.lit(', "note": "'), "event_type", F.lit('\tx"}'))
    E.write_entity(t.events.select(line.alias("value")), path, "text")
    return E.read_entity(t.spark, path, "json", "event_id bigint, k bigint, note string", control_chars=True)


@query("s4_compressed_files", "SELECT 'gzip' AS kind, o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'zstd', o_orderkey, o_totalprice FROM orders")
def _(t):
    out = None
    rows = t.orders.select("o_orderkey", "o_totalprice")
    for kind, fmt in (("gzip", "csv"), ("zstd", "parquet")):
        path = shared_path(t.spark, kind)
        E.write_entity(rows, path, fmt, compression=kind)
        back = E.read_entity(t.spark, path, fmt, rows.schema).select(F.lit(kind).alias("kind"), "*")
        out = back if out is None else out.unionByName(back)
    return out


@query(
    "s5_file_pattern_entity",
    "SELECT year(o_orderdate)::VARCHAR AS year, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2",
)
def _(t):
    path = shared_path(t.spark, "pattern")
    rows = t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("s"))
    E.write_entity(rows, path, "json", partition_by=["y", "s"])
    df = E.read_pattern(t.spark, path, "*.json", "/y=(?<year>[0-9]{4})/s=(?<status>[A-Z])/", "json", "o_orderkey bigint, o_totalprice double")
    return df.groupBy("year", "status").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "s6_sql_entity",
    """SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 250000.0 GROUP BY 1""",
)
def _(t):
    text = """SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {customer} JOIN {orders} ON c_custkey = o_custkey
              WHERE o_totalprice > :floor GROUP BY c_mktsegment"""
    return E.read_sql(t.spark, text, {"floor": 250000.0}, customer=t.customer, orders=t.orders)


@query(
    "s7_key_range_planner",
    """WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, ceil((max(o_orderkey) - min(o_orderkey) + 1) / 7)::BIGINT AS w FROM orders)
       SELECT i::INTEGER AS part, (b.lo + i * w)::BIGINT AS lo, least(b.lo + (i + 1) * w, b.hi + 1)::BIGINT AS hi FROM b, range(0, 7) g(i) WHERE b.lo + i * w <= b.hi""",
)
def _(t):
    return E.key_ranges(t.orders, "o_orderkey", 7)


@query("s8_target_write", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def _(t):
    path = shared_path(t.spark, "target")
    rows = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    E.write_entity(rows, path, "parquet", partition_by=["l_returnflag"], max_records=20000)
    back = E.read_entity(t.spark, path, "parquet")
    return back.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.sum("l_quantity").alias("qty")
    )


@query(
    "s9_keyed_merge",
    """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer
       UNION ALL SELECT -1 - c_custkey, c_name, c_nationkey, c_acctbal + 10, NULL FROM customer WHERE c_custkey % 100 = 3""",
)
def _(t):
    set_all, set_some = F.array(F.lit("c_acctbal"), F.lit("c_mktsegment")), F.array(F.lit("c_acctbal"))
    old = t.customer.where("c_custkey % 4 = 0")
    new = t.customer.where("c_custkey % 100 = 3").withColumn("c_custkey", -1 - F.col("c_custkey"))
    source = old.unionByName(new).withColumns(
        {
            "c_acctbal": F.col("c_acctbal") + 10,
            "c_mktsegment": F.lit(None).cast("string"),
            "set_fields": F.when(F.col("c_custkey") % 8 == 0, set_all).otherwise(set_some),
        }
    )
    return M.merge_into(t.customer, source, ["c_custkey"], present="set_fields")


@query(
    "s10_patch_list",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 1 THEN 'merged' WHEN c_custkey % 5 = 2 THEN 'again' ELSE c_name END AS c_name, c_nationkey,
       CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0
       UNION ALL SELECT -1 - c_custkey, 'fresh', c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 0""",
)
def _(t):
    step = lambda df, seq, op: df.withColumns({"seq": F.lit(seq), "operation": F.lit(op)})
    c = t.customer
    only_name = lambda df, name: df.withColumns({"c_name": F.lit(name), "c_nationkey": F.lit(None).cast("int"), "c_acctbal": F.lit(None).cast("double"), "c_mktsegment": F.lit(None).cast("string")})
    parts = [
        step(c.where("c_custkey % 5 = 0"), 1, "REMOVE"),
        step(c.where("c_custkey % 5 = 0").withColumn("c_custkey", -900000000000 - F.col("c_custkey")), 1, "REMOVE"),
        step(only_name(c.where("c_custkey % 5 = 1"), "merged"), 1, "MERGE"),
        step(c.where("c_custkey % 5 = 2"), 1, "REMOVE"),
        step(c.where("c_custkey % 5 = 2").withColumns({"c_name": F.lit("again"), "c_acctbal": F.lit(None).cast("double")}), 2, "INSERT"),
        step(only_name(c.where("c_custkey % 50 = 0").withColumn("c_custkey", -1 - F.col("c_custkey")), "fresh"), 2, "MERGE"),
        step(c.where("c_custkey % 50 = 0").withColumn("c_custkey", -1 - F.col("c_custkey")), 1, "INSERT"),
    ]
    patch = parts[0]
    for p in parts[1:]:
        patch = patch.unionByName(p)
    return M.apply_patch(c, patch, ["c_custkey"])


@query(
    "s11_schema_drift",
    "SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, NULL::BIGINT AS o_orderstatus, o_totalprice, NULL::VARCHAR AS o_comment FROM orders",
)
def _(t):
    expected = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.StringType()), T.StructField("o_orderstatus", T.LongType()),
            T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_comment", T.StringType()),
        ]
    )
    return E.read_with_drift(t.orders.withColumn("o_extra", F.lit(1)), expected)


CHANGES = """ch AS (SELECT event_id % (SELECT count(*) FROM orders) AS o_orderkey, event_id AS seq, CASE event_type WHEN 'error' THEN 'D' ELSE 'U' END AS op,
 event_type AS o_orderstatus, value AS o_totalprice FROM events UNION ALL SELECT -1 - event_id, event_id, 'U', 'new', value FROM events WHERE event_type = 'signup'),
 l AS (SELECT o_orderkey, arg_max(op, seq) AS op, arg_max(o_orderstatus, seq) AS s, arg_max(o_totalprice, seq) AS p FROM ch GROUP BY 1)"""


@query(
    "s12_change_feed",
    f"""WITH {CHANGES} SELECT coalesce(l.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN l.op IS NULL THEN o_orderstatus ELSE s END AS o_orderstatus,
       CASE WHEN l.op IS NULL THEN o_totalprice ELSE p END AS o_totalprice FROM orders o FULL JOIN l ON o.o_orderkey = l.o_orderkey WHERE l.op IS DISTINCT FROM 'D'""",
)
def _(t):
    n = t.orders.agg(F.count("*")).scalar()
    cols = lambda df, key, status: df.select(
        key.alias("o_orderkey"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"),
        status.alias("o_orderstatus"), F.col("value").alias("o_totalprice"),
    )
    changes = cols(t.events, F.col("event_id") % n, F.col("event_type")).unionByName(
        cols(t.events.where("event_type = 'signup'"), -1 - F.col("event_id"), F.lit("new"))
    )
    snapshot = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return M.apply_changes(snapshot, changes, ["o_orderkey"], "seq", "op")


@query(
    "s13_mapping_rules",
    """SELECT DISTINCT lower(p_type) || '.' || lower(p_brand) AS entity FROM part WHERE (p_type = 'SMALL' AND NOT lower(p_brand) LIKE 'brand#1%') OR (p_type = 'PROMO') OR lower(p_brand) = 'brand#13'""",
)
def _(t):
    names = t.part.select(F.lower(F.concat_ws(".", "p_type", "p_brand")).alias("entity")).distinct()
    rules = [("include", "small.*"), ("exclude", "*.brand#1*"), ("include", "promo.*"), ("include", "*.brand#13")]
    return I.select_entities(names, "entity", rules)


@query(
    "s14_log_ingest",
    """WITH e AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS l FROM conversations), x AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM e)
       SELECT 'conv' || conv_id AS source, (turn * 1000 + i - 1)::BIGINT AS id, CASE WHEN i = 1 THEN 'head' ELSE role END AS type, (CASE WHEN i % 2 = 0 THEN turn ELSE conv_id END)::BIGINT AS time, l[i] AS data FROM x""",
)
def _(t):
    entries = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            (F.col("turn") * 1000 + i).alias("id"), F.when(i % 2 == 1, F.col("turn")).alias("time"), F.when(i == 0, "head").alias("type"), line.alias("data")
        ),
    )
    batches = t.conversations.select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("source"), F.col("role").alias("type"), F.col("conv_id").alias("default_time"), entries.alias("entries")
    )
    return I.ingest_logs(batches).select("source", "id", "type", "time", "data")


@query(
    "s15_metric_post",
    """WITH m AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS name, event_id % 7 = 0 AS bare, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events),
       r AS (SELECT *, CASE WHEN name = '' THEN 'MISSING_NAME' WHEN bare THEN 'NO_DIMENSION' WHEN value IS NULL THEN 'NO_VALUE' END AS reason FROM m)
       SELECT coalesce(reason, 'OK') AS reason, name, count(*) AS n, round(sum(value), 2) AS total FROM r GROUP BY 1, 2""",
)
def _(t):
    dims = F.when(F.col("event_id") % 7 != 0, F.create_map(F.lit("user"), F.col("user_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    value = F.when(F.col("event_id") % 5 != 0, F.col("value"))
    posts = t.events.select(
        F.lit("app").alias("namespace"), F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("event_type")).alias("name"), dims.alias("dimensions"),
        F.array(F.struct("ts", value.alias("value"))).alias("datapoints"),
    )
    good, bad = I.ingest_metrics(posts)
    both = good.withColumn("reason", F.lit("OK")).unionByName(bad)
    return both.groupBy("reason", "name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s16_archive_export", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(t):
    path = shared_path(t.spark, "archive")
    E.export_partitioned(t.events.select("event_id", "value", "ts", "event_type"), path, {"day": "date_format(ts, 'yyyy-MM-dd')", "kind": "event_type"}, "json", 5000)
    df = E.read_entity(t.spark, path, "json", "event_id bigint, value double, day string, kind string")
    return df.groupBy("day", "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "s17_object_inventory",
    """WITH o AS (SELECT regexp_replace(url, '^https?://', 'site/') AS name, length(html)::BIGINT AS bytes FROM pages), r AS (SELECT substr(name, 6) AS rest, bytes FROM o)
       SELECT 'site/' || CASE WHEN contains(rest, '/') THEN substr(rest, 1, instr(rest, '/')) ELSE rest END AS prefix, count(*) AS objects, sum(bytes)::BIGINT AS bytes FROM r GROUP BY 1""",
)
def _(t):
    inv = t.pages.select(F.regexp_replace("url", "^https?://", "site/").alias("name"), F.length("html").cast("bigint").alias("bytes"))
    return I.list_objects(inv, "site/", "/")


@query(
    "s18_lifecycle",
    """WITH o AS (SELECT o_orderkey, lower(o_orderstatus) || '/' || o_orderkey AS name, date_diff('day', o_orderdate::DATE, DATE '2001-08-01')::INTEGER AS age_days FROM orders),
       a AS (SELECT *, CASE WHEN starts_with(name, 'f/') AND age_days >= 2000 AND age_days >= 1900 THEN 'DELETE' WHEN age_days >= 1000 AND name LIKE '%7' THEN 'ARCHIVE' WHEN starts_with(name, 'p/') AND age_days >= 365 THEN 'INFREQUENT' END AS action FROM o)
       SELECT o_orderkey, age_days, action FROM a WHERE action IS NOT NULL""",
)
def _(t):
    inv = t.orders.select("o_orderkey", F.concat(F.lower("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderdate").alias("modified"))
    rules = [I.LifecycleRule("INFREQUENT", 365, "p/"), I.LifecycleRule("ARCHIVE", 1000, pattern="*7"), I.LifecycleRule("DELETE", 2000, "f/")]
    return I.lifecycle_actions(inv, rules, "2001-08-01", retention_days=1900).select("o_orderkey", "age_days", "action")


@query(
    "s19_paging",
    """SELECT 'all' AS kind, o_orderkey, ((row_number() OVER w - 1) // 100 + 1)::BIGINT AS page, ((row_number() OVER w - 1) % 100 + 1)::BIGINT AS position FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)
       UNION ALL (SELECT 'limit', o_orderkey, NULL, NULL FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)
       UNION ALL (SELECT 'after', o_orderkey, NULL, NULL FROM orders WHERE (o_custkey, o_orderkey) > (500, 100) ORDER BY o_custkey, o_orderkey LIMIT 25)""",
)
def _(t):
    every = I.pages(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100, F.date_trunc("day", "o_orderdate"))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("page", "position")]
    best = E.take_up_to(t.orders.withColumn("minus", -F.col("o_totalprice")), 25, ["minus", "o_orderkey"])
    after = E.page_after(t.orders, ["o_custkey", "o_orderkey"], [500, 100], 25)
    out = every.select(F.lit("all").alias("kind"), "o_orderkey", "page", "position")
    out = out.unionByName(best.select(F.lit("limit").alias("kind"), "o_orderkey", *none))
    return out.unionByName(after.select(F.lit("after").alias("kind"), "o_orderkey", *none))
