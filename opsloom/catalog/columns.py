"""Queries of the projection, filter and column-rule family."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.catalog.registry import query
from opsloom.operators import columns as C
from opsloom.plans.predicates import Cond, Negate, all_of, any_of


@query("p1_projection", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, upper(l_returnflag) AS flag FROM lineitem")
def _(t):
    return C.project(t.lineitem, ["l_orderkey", "l_extendedprice * (1 - l_discount) AS net", "upper(l_returnflag) AS flag"])


@query(
    "p2_filter_where",
    "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1997-01-01'",
)
def _(t):
    df = C.where(t.lineitem, all_of(Cond("l_quantity", ">", 45), "l_shipdate >= TIMESTAMP_NTZ '1997-01-01'"))
    return df.select("l_orderkey", "l_quantity", "l_shipdate")


@query(
    "p3_full_row_search",
    """SELECT doc_id, lang FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(text), 'ist'))
       AND NOT contains(lower(text), 'example.com')""",
)
def _(t):
    tree = all_of(any_of("THE", "Ist"), Negate("example.com"))
    return C.search(t.documents, tree, ["text"]).select("doc_id", "lang")


@query(
    "p4_structured_search",
    """SELECT p_partkey, p_name, p_size FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_size BETWEEN 5 AND 30
       AND p_name LIKE 'r%'""",
)
def _(t):
    conds = [Cond("p_brand", "in", ["Brand#1", "Brand#2"]), Cond("p_size", "between", (5, 30)), Cond("p_name", "starts with", "r")]
    df = C.structured_search(t.part, conds, ["p_brand", "p_size", "p_name"], [("p_size", "desc"), ("p_name", "asc")])
    return df.select("p_partkey", "p_name", "p_size")


@query(
    "p5_eval",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.05 THEN 'deep' ELSE 'shallow' END AS cut,
       round(l_extendedprice * (1 + l_tax), 4) AS gross FROM lineitem""",
)
def _(t):
    df = C.eval_(t.lineitem, "cut", "CASE WHEN l_discount > 0.05 THEN 'deep' ELSE 'shallow' END")
    df = C.eval_(df, "gross", "round(l_extendedprice * (1 + l_tax), 4)")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "cut", "gross")


@query("p6_field_list", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return C.fields(t.orders, add=["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"], drop=["o_orderstatus"])


@query(
    "p7_rename",
    """SELECT o_orderkey AS id, o_custkey AS custkey, o_orderstatus AS orderstatus, o_totalprice AS totalprice,
       o_orderdate AS orderdate, o_orderpriority AS orderpriority FROM orders""",
)
def _(t):
    return C.rename(t.orders, {"o_orderkey": "id"}, pattern="^o_", to="")


@query("p8_column_rules", "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_orderkey FROM lineitem")
def _(t):
    return C.columns_where(t.lineitem, names=["l_orderkey"], pattern=".*date", types=["double"])


@query(
    "p9_macro_field",
    """SELECT l_orderkey, l_partkey, floor(l_quantity)::BIGINT AS l_quantity_f, floor(l_extendedprice)::BIGINT AS l_extendedprice_f
       FROM lineitem""",
)
def _(t):
    cols = C.matching_columns(t.lineitem, names=["l_quantity"], pattern=".*price")
    df = C.macro(t.lineitem, cols, "floor(%MACRO%)", "%MACRO%_f")
    return df.select("l_orderkey", "l_partkey", "l_quantity_f", "l_extendedprice_f")


@query(
    "p10_field_mapping",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, coalesce(nullif(c_mktsegment, ''), c_name) AS label,
       c_nationkey::BIGINT AS nation, NULL::VARCHAR AS note FROM customer""",
)
def _(t):
    target = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("name", T.StringType()),
            T.StructField("acctbal", T.DoubleType()),
            T.StructField("label", T.StringType()),
            T.StructField("nation", T.LongType()),
            T.StructField("note", T.StringType()),
        ]
    )
    return C.map_fields(
        t.customer,
        target,
        direct={"id": "c_custkey", "nation": "c_nationkey"},
        rules=[("c_(name|acctbal)", r"\1")],
        composite={"label": ["c_mktsegment", "c_name"]},
    )


@query("p11_flatten", "SELECT conv_id, turn AS entry_turn, role AS entry_role, length(text)::INTEGER AS n FROM conversations")
def _(t):
    nested = t.conversations.select("conv_id", F.array(F.struct("turn", "role", "text")).alias("entry"))
    return C.flatten(nested, "entry").select("conv_id", "entry_turn", "entry_role", F.length("entry_text").alias("n"))


@query(
    "p12_split",
    """SELECT route, mode, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (
       SELECT o_totalprice, 'first' AS mode, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_orderpriority = '1-URGENT' THEN 'urgent'
       ELSE 'other' END AS route FROM orders
       UNION ALL SELECT o_totalprice, 'all', 'big' FROM orders WHERE o_totalprice > 300000
       UNION ALL SELECT o_totalprice, 'all', 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT'
       UNION ALL SELECT o_totalprice, 'all', 'other' FROM orders WHERE NOT (o_totalprice > 300000 OR o_orderpriority = '1-URGENT')
       ) GROUP BY route, mode""",
)
def _(t):
    routes = {"big": Cond("o_totalprice", ">", 300000), "urgent": Cond("o_orderpriority", "=", "1-URGENT")}
    out = None
    for mode in ("first", "all"):
        for name, part in C.split(t.orders, routes, mode).items():
            part = part.select("o_totalprice", F.lit(mode).alias("mode"), F.lit(name).alias("route"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("route", "mode").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


URL = "^(?<scheme>https?)://(?<host>[^/?#]+)/(?<section>[a-z]+)/(?<item>[0-9]+)"
URL_SQL = "^(https?)://([^/?#]+)/([a-z]+)/([0-9]+)"


@query(
    "p13_extract_named_groups",
    f"""SELECT page_id, CASE WHEN regexp_matches(url, '{URL_SQL}') THEN regexp_extract(url, '{URL_SQL}', 1) END AS scheme,
       CASE WHEN regexp_matches(url, '{URL_SQL}') THEN regexp_extract(url, '{URL_SQL}', 2) END AS host,
       CASE WHEN regexp_matches(url, '{URL_SQL}') THEN regexp_extract(url, '{URL_SQL}', 3) END AS section,
       CASE WHEN regexp_matches(url, '{URL_SQL}') THEN regexp_extract(url, '{URL_SQL}', 4) END AS item FROM pages""",
)
def _(t):
    return C.extract(t.pages.select("page_id", "url"), "url", URL).drop("url")


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


@query("p14_regex_filter", f"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '{EMAIL}') AND regexp_matches(text, '[0-9]{{3}}')")
def _(t):
    df = C.regex(t.documents.select("doc_id", "text"), "text", EMAIL, negate=True)
    return C.regex(df, "text", "[0-9]{3}").select("doc_id")


@query(
    "p15_log_parsing",
    f"""WITH m AS (SELECT page_id, url, regexp_matches(url, '^https://([^/?#]+)/([a-z]+)/') AS ok FROM pages)
       SELECT 'page' AS kind, page_id AS id, CASE WHEN ok THEN regexp_extract(url, '^https://([^/?#]+)/([a-z]+)/', 1) END AS f1,
       CASE WHEN ok THEN regexp_extract(url, '^https://([^/?#]+)/([a-z]+)/', 2) END AS f2,
       CASE WHEN NOT ok THEN 'NO_MATCH' END AS parse_error FROM m
       UNION ALL SELECT 'event', event_id, json_extract_string(props, '$.k'), json_extract_string(props, '$.z'), NULL FROM events
       UNION ALL SELECT 'part', p_partkey, CASE WHEN n = 2 THEN a END, CASE WHEN n = 2 THEN b END,
       CASE WHEN n <> 2 THEN 'FIELD_COUNT' END FROM (SELECT p_partkey, len(string_split(p_name, ' ')) AS n,
       string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)""",
)
def _(t):
    pages = C.parse_logs(t.pages, "url", "regex", "^https://(?<f1>[^/?#]+)/(?<f2>[a-z]+)/")
    events = C.parse_logs(t.events, "props", "json", {"f1": "$.k", "f2": "$.z"})
    parts = C.parse_logs(t.part, "p_name", "delimited", (" ", ["f1", "f2"]))
    cols = ["f1", "f2", "parse_error"]
    return (
        pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), *cols)
        .unionByName(events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), *cols))
        .unionByName(parts.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), *cols))
    )


def log_lines(t):
    """Log lines built from events: time, level and message; views carry no header."""
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.upper("event_type"), F.lit("] "))
    body = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" props="), F.col("props"))
    return t.events.select("event_id", F.when(F.col("event_type") == "view", body).otherwise(F.concat(head, body)).alias("line"))


@query(
    "p16_log_header",
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN date_trunc('second', ts)::TIMESTAMP END AS log_time,
       CASE WHEN event_type <> 'view' THEN upper(event_type) END AS level,
       'user=' || user_id || ' props=' || props AS body FROM events""",
)
def _(t):
    return C.extract_header(log_lines(t), "line").drop("line")


@query(
    "p17_extended_fields",
    f"""SELECT doc_id, CASE WHEN lang = 'en' AND regexp_matches(text, '([A-Za-z0-9._]+)@([A-Za-z0-9.-]+)')
       THEN regexp_extract(text, '([A-Za-z0-9._]+)@([A-Za-z0-9.-]+)', 2) END AS mail_host,
       CASE WHEN lang = 'de' AND regexp_matches(text, '^([A-Za-z]+) ') THEN regexp_extract(text, '^([A-Za-z]+) ', 1) END AS first_word
       FROM documents""",
)
def _(t):
    rules = [
        (Cond("lang", "=", "en"), "text", "([A-Za-z0-9._]+)@(?<mailhost>[A-Za-z0-9.-]+)"),
        (Cond("lang", "=", "de"), "text", "^(?<firstword>[A-Za-z]+) "),
    ]
    df = C.extended_fields(t.documents, rules)
    return df.select("doc_id", F.col("mailhost").alias("mail_host"), F.col("firstword").alias("first_word"))


@query("p18_json_path", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, json_extract_string(props, '$.none') AS missing FROM events")
def _(t):
    df = C.json_project(t.events, "props", {"k": "$.k", "missing": "$.none"})
    return df.select("event_id", F.col("k").try_cast("int").alias("k"), "missing")


@query(
    "p19_unknown_enum",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'UNKNOWN_ENUM_VALUE' END AS event_type
       FROM events""",
)
def _(t):
    return C.coerce_enum(t.events, "event_type", ["click", "view", "purchase"]).select("event_id", "event_type")


@query(
    "p20_utc_normalisation",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN ts - INTERVAL 2 HOUR ELSE ts END AS from_text,
       ts - INTERVAL 1 HOUR AS from_zone FROM events""",
)
def _(t):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    df = t.events.withColumn("from_text", F.when(F.col("event_type") == "click", F.concat(text, F.lit("+02:00"))).otherwise(text))
    df = C.to_utc(df, "from_text")
    return C.to_utc(df, "ts", tz="+01:00", out="from_zone").select("event_id", "from_text", "from_zone")


@query(
    "p21_identifier_snake",
    """SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(p_brand || ':' || p_name || 'Item-' || p_type,
       '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS ident FROM part""",
)
def _(t):
    raw = F.concat("p_brand", F.lit(":"), "p_name", F.lit("Item-"), "p_type")
    return C.to_snake(t.part.select("p_partkey", raw.alias("ident")), "ident")


@query(
    "p22_parameterised_query",
    """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
       WHERE o_totalprice >= 100000.0 AND o_orderpriority = '2-HIGH' GROUP BY o_orderstatus""",
)
def _(t):
    sql = """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders}
             WHERE o_totalprice >= :floor AND o_orderpriority = :priority GROUP BY o_orderstatus"""
    return C.run_template(t.spark, sql, {"floor": 100000.0, "priority": "2-HIGH"}, orders=t.orders)


@query(
    "p23_data_object_query",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value > 5.0
       AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type""",
)
def _(t):
    return C.data_object_query(
        t.events,
        ["event_type", "n", "mean"],
        [Cond("value", ">", ":floor")],
        ["event_type"],
        {"n": "count(*)", "mean": "round(avg(value), 6)"},
        ["event_type"],
        ts="ts",
        start="2024-01-05",
        end="2024-01-20",
        params={"floor": 5.0},
    )


@query(
    "p24_unit_conversion",
    """SELECT event_id, round(value * 1024.0 * 1024.0 / 1024.0, 6) AS kb, round((value - 32) * 5 / 9, 6) AS celsius,
       round(value * 60.0, 6) AS seconds, round(value / 60.0, 8) AS per_second FROM events""",
)
def _(t):
    df = C.convert_units(t.events, "value", "MB", "KB", "kb")
    df = C.convert_units(df, "value", "F", "C", "celsius")
    df = C.convert_units(df, "value", "min", "s", "seconds")
    df = C.convert_units(df, "value", "per_minute", "per_second", "per_second")
    cols = [F.round(c, 6).alias(c) for c in ("kb", "celsius", "seconds")]
    return df.select("event_id", *cols, F.round("per_second", 8).alias("per_second"))
