"""Queries of the log mining family."""

from pyspark.sql import functions as F

from opsloom.catalog.registry import query
from opsloom.catalog.windows import SERIES
from opsloom.operators import logs as X
from opsloom.plans.predicates import Cond

LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


def lines(t):
    return t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


def sql_template(col):
    for pattern, slot in X.SLOTS:
        col = f"regexp_replace({col}, '{pattern}', '{slot}', 'g')"
    return f"trim(regexp_replace({col}, '[ \\t]+', ' ', 'g'))"


@query(
    "x1_cluster_messages",
    f"""SELECT template, count(*) AS n, min(line) AS sample, md5(template) AS template_id
       FROM (SELECT line, {sql_template('line')} AS template FROM ({LINES})) GROUP BY template""",
)
def _(t):
    return X.cluster(lines(t), "line")


@query(
    "x2_outlier",
    """WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS med, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
       FROM lineitem GROUP BY 1), d AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1),
       mad AS (SELECT event_type, any_value(med) AS med, median(abs(value - med)) AS mad FROM events JOIN d USING (event_type) GROUP BY 1)
       SELECT 'mad' AS method, event_id AS id, value, round(0.6745 * (value - med) / mad, 6) AS robust_z FROM events JOIN mad USING (event_type)
       WHERE abs(0.6745 * (value - med) / mad) > 4
       UNION ALL SELECT 'iqr', l_orderkey * 10 + l_linenumber, l_extendedprice, NULL FROM lineitem JOIN m USING (l_returnflag)
       WHERE l_extendedprice < q1 - 0.5 * (q3 - q1) OR l_extendedprice > q3 + 0.5 * (q3 - q1)""",
)
def _(t):
    z = X.outlier(t.events, ["event_type"], "value", 4.0)
    z = z.select(F.lit("mad").alias("method"), F.col("event_id").alias("id"), "value", F.round("robust_z", 6).alias("robust_z"))
    fence = X.outlier(t.lineitem, ["l_returnflag"], "l_extendedprice", 0.5, "iqr")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    return z.unionByName(
        fence.select(F.lit("iqr").alias("method"), key, F.col("l_extendedprice").alias("value"), F.lit(None).cast("double").alias("robust_z"))
    )


@query(
    "x3_series_anomaly",
    SERIES.format(key="event_type", span="hour", agg="sum(value)")
    + """, r AS (SELECT *, avg(v) OVER w AS mean, stddev_samp(v) OVER w AS sigma, count(v) OVER w AS k FROM f
       WINDOW w AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
       SELECT event_type, bucket, round(v, 2) AS v, round(mean, 6) AS mean, round(sigma, 6) AS sigma FROM r WHERE k = 24 AND round(abs(v - mean) - 3.0 * sigma, 9) > 0""",
)
def _(t):
    df = X.anomaly(t.events, ["event_type"], "ts", "hour", "sum(value)", 24, 3.0)
    return df.select("event_type", "bucket", F.round("v", 2).alias("v"), F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"))


@query(
    "x4_classify",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
       h AS (SELECT n, coalesce(sum(sum(n)) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM c GROUP BY n)
       SELECT user_id, event_type, n, CASE WHEN above / (SELECT count(*) FROM events) < 0.8 THEN 'common' ELSE 'unusual' END AS kind FROM c JOIN h USING (n)""",
)
def _(t):
    return X.classify(t.events, ["user_id", "event_type"], 0.8)


# fixed values: words too common to be keywords
STOP = ["the", "and", "of", "in", "to", "der", "die", "und", "ist", "de", "la", "le", "et", "el", "que"]


@query(
    "x5_keywords",
    f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-zà-öø-ÿ]+')) AS word FROM documents),
       tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word <> '' AND word NOT IN ({', '.join(repr(s) for s in STOP)}) GROUP BY 1, 2),
       df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
       s AS (SELECT doc_id, word, tf, df, round(tf * ln((SELECT count(*) FROM documents)::DOUBLE / df), 6) AS score FROM tf JOIN df USING (word))
       SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word)::INTEGER AS rank FROM s) WHERE rank <= 5""",
)
def _(t):
    return X.keywords(t.documents, "doc_id", "text", 5, STOP)


@query(
    "x6_labelling_rules",
    """SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'failure' END, CASE WHEN value > 100 THEN 'large' END,
       CASE WHEN user_id < 10 THEN 'early' END) AS labels, greatest(CASE WHEN event_type = 'error' THEN 3 END, CASE WHEN value > 100 THEN 2 END,
       CASE WHEN user_id < 10 THEN 1 END) AS priority FROM events""",
)
def _(t):
    rules = [(Cond("event_type", "=", "error"), "failure", 3), (Cond("value", ">", 100), "large", 2), (Cond("user_id", "<", 10), "early", 1)]
    return X.label(t.events, rules).select("event_id", F.array_join("labels", ",").alias("labels"), "priority")


@query(
    "x7_ingest_rules",
    """WITH r AS (SELECT 'errors' AS rule, ts, value FROM events WHERE event_type = 'error' UNION ALL SELECT 'spend', ts, value FROM events
       WHERE event_type = 'purchase' AND value > 20)
       SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, rule, count(*) AS n, round(sum(value), 2) AS total FROM r GROUP BY 1, 2""",
)
def _(t):
    rules = [("errors", Cond("event_type", "=", "error")), ("spend", "event_type = 'purchase' AND value > 20")]
    df = X.ingest_rules(t.events, rules, "ts", "1 hour", "value")
    return df.select(F.col("w.start").alias("bucket"), "rule", "n", F.round("total", 2).alias("total"))


@query(
    "x8_entity_association",
    """SELECT o_orderpriority, count(*) FILTER (WHERE c_custkey IS NOT NULL) AS matched, count(*) FILTER (WHERE c_custkey IS NULL) AS unmatched,
       count(DISTINCT c_custkey) AS association_count FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
       ON o_custkey = c_custkey GROUP BY 1""",
)
def _(t):
    entities = t.customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return X.associations(t.orders, entities, "o_custkey", "o_orderpriority")


@query(
    "x9_pattern_coverage",
    """WITH p AS (SELECT 'secure' AS pattern FROM pages WHERE regexp_matches(url, '^https://') UNION ALL SELECT 'fragment' FROM pages WHERE regexp_matches(url, '#')
       UNION ALL SELECT 'query' FROM pages WHERE regexp_matches(url, '[?]') UNION ALL SELECT 'unmatched' FROM pages WHERE NOT regexp_matches(url, '^https://')
       AND NOT regexp_matches(url, '#') AND NOT regexp_matches(url, '[?]'))
       SELECT pattern, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM pages), 6) AS share FROM p GROUP BY 1""",
)
def _(t):
    return X.pattern_report(t.pages, "url", {"secure": "^https://", "fragment": "#", "query": "[?]"})


RANGES = """SELECT event_id, user_id, ts AS s, ts + to_minutes((30 + event_id % 2000)::BIGINT) AS e FROM events"""


def ranges(t):
    length = F.expr("make_dt_interval(0, 0, 30 + event_id % 2000)")
    return t.events.select("event_id", "user_id", F.col("ts").alias("s"), (F.col("ts") + length).alias("e"))


@query(
    "x10_overlap_islands",
    f"""WITH r AS ({RANGES}), a AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
       b AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a)
       SELECT user_id, min(s) AS island_start, max(e) AS island_end, count(*) AS members FROM b GROUP BY user_id, island""",
)
def _(t):
    return X.islands(ranges(t), ["user_id"], "s", "e", "event_id", F.date_trunc("hour", "s"))


@query(
    "x10_overlap_counts",
    f"""WITH r AS ({RANGES}) SELECT a.user_id, a.event_id, count(b.event_id) AS overlaps FROM r a LEFT JOIN r b
       ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.s < a.e AND b.e > a.s GROUP BY 1, 2""",
)
def _(t):
    return X.overlap_counts(ranges(t), ["user_id"], "s", "e", "event_id", lambda c: F.date_trunc("hour", c))


@query(
    "x10_overlap_pairs",
    f"""WITH r AS ({RANGES}) SELECT a.user_id, a.event_id AS "first", b.event_id AS "second", b.s AS overlap_start, least(a.e, b.e) AS overlap_end FROM r a JOIN r b
       ON a.user_id = b.user_id AND (a.s < b.s OR (a.s = b.s AND a.event_id < b.event_id)) AND a.e > b.s""",
)
def _(t):
    return X.overlap_pairs(ranges(t), ["user_id"], "s", "e", "event_id")
