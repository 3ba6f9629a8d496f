"""Queries of the text and label family."""

from pyspark.sql import functions as F

from opsloom.catalog.registry import query
from opsloom.operators import text as L
from opsloom.plans.predicates import Cond

WORDS = "list_filter(string_split_regex(lower(text), '[^a-zà-öø-ÿ]+'), lambda w: w <> '')"


def in_list(words):
    return ", ".join(f"'{w}'" for w in words)


SCORES = ", ".join(
    f"len(list_filter(t, lambda w: w IN ({in_list(ws)}))) / greatest(len(t), 1) AS score_{lang}" for lang, ws in sorted(L.FUNCTION_WORDS.items())
)


@query(
    "l1_dominant_language",
    f"""WITH w AS (SELECT doc_id, lang, {WORDS} AS t FROM documents), s AS (SELECT doc_id, lang, {SCORES} FROM w), b AS (SELECT *, greatest(score_de, score_en, score_es, score_fr) AS best FROM s)
       SELECT doc_id, lang, CASE WHEN best = 0 THEN 'und' WHEN score_de = best THEN 'de' WHEN score_en = best THEN 'en' WHEN score_es = best THEN 'es' ELSE 'fr' END AS language, round(best, 6) AS score FROM b""",
)
def _(t):
    return L.detect_language(t.documents, "text").select("doc_id", "lang", "language", F.round("score", 6).alias("score"))


def pii_sql(name, pattern):
    digit = "substr(regexp_replace(m[i], '[- ]', '', 'g'), (16 - j)::INTEGER, 1)::INTEGER"
    luhn = (
        f"list_sum(list_transform(range(0, 16), lambda j: CASE WHEN j % 2 = 0 THEN {digit} "
        f"WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0"
    )
    check = f"WHERE {luhn}" if name == "CARD" else ""
    return f"""SELECT doc_id, '{name}' AS type, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER AS "offset",
     m[i] AS entity, length(m[i])::INTEGER AS length FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM documents), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) {check}"""


@query(
    "l2_pii_detection",
    " UNION ALL ".join(pii_sql(n, p) for n, p in L.PII.items()),
)
def _(t):
    return L.detect_pii(t.documents, ["doc_id"], "text")


def pieces_sql(col, pattern, change):
    return f"""array_to_string(list_transform(range(1, len(string_split_regex({col}, '{pattern}')) + 1), lambda i: string_split_regex({col}, '{pattern}')[i] ||
     coalesce({change.format(m=f"regexp_extract_all({col}, '{pattern}')[i]")}, '')), '')"""


def relex(name):
    pool = L.STAND_INS[name]
    return f"([{in_list(pool)}])[('0x' || substr(md5('s|' || {{m}}), 1, 8))::BIGINT % {len(pool)} + 1]"


def luhn_sql(m):
    digit = f"substr(regexp_replace({m}, '[- ]', '', 'g'), (16 - j)::INTEGER, 1)::INTEGER"
    return f"list_sum(list_transform(range(0, 16), lambda j: CASE WHEN j % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0"


def handled_sql(mode, change):
    """Type after type, each on the text that the one before left; card numbers only with a right check digit."""
    steps, source = [], "documents"
    for i, (name, pattern) in enumerate(L.PII.items()):
        new = change(name)
        if name == "CARD":
            new = f"CASE WHEN {luhn_sql('{m}')} THEN {new} ELSE {{m}} END"
        steps.append(f"{mode}{i} AS MATERIALIZED (SELECT doc_id, {pieces_sql('text', pattern, new)} AS text FROM {source})")
        source = f"{mode}{i}"
    return ", ".join(steps), f"SELECT doc_id, '{mode}' AS mode, md5(text) AS digest FROM {source}"


HANDLED = [
    handled_sql("REPLACE", lambda name: f"CASE WHEN {{m}} IS NOT NULL THEN '<{name}>' END"),
    handled_sql("REMOVE", lambda name: "''"),
    handled_sql("MASK", lambda name: "repeat('*', greatest(length({m}) - 4, 0)) || right({m}, 4)"),
    handled_sql("RELEXIFY", relex),
]


@query("l3_pii_handling_modes", f"WITH {', '.join(steps for steps, _ in HANDLED)} {' UNION ALL '.join(rows for _, rows in HANDLED)}")
def _(t):
    """All types in all modes."""
    docs = t.documents.select("doc_id", "text")
    variants = {mode: L.mask_pii(docs, "text", mode, keep_last=4) for mode in ("REPLACE", "REMOVE", "MASK", "RELEXIFY")}
    out = None
    for mode, df in variants.items():
        df = df.select("doc_id", F.lit(mode).alias("mode"), F.md5(F.col("text").cast("binary")).alias("digest"))
        out = df if out is None else out.unionByName(df)
    return out


@query(
    "l4_document_errors",
    """SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'EMPTY' WHEN length(trim(text)) < 40 THEN 'TOO_SHORT' WHEN length(trim(text)) > 5000 THEN 'TOO_LONG'
       WHEN NOT regexp_matches(lower(text), '[a-zà-öø-ÿ]') THEN 'NO_LETTERS' END AS error FROM documents""",
)
def _(t):
    return L.with_errors(t.documents, "text", 40, 5000).select("doc_id", "error")


EVAL = """j AS (SELECT quality AS y, (n_chars > 300)::INTEGER AS p, doc_id FROM labels JOIN documents USING (doc_id)), c AS (SELECT y, p, count(*) AS n FROM j GROUP BY 1, 2),
 k AS (SELECT class, sum(re) AS re, sum(sa) AS sa, sum(hit) AS hit FROM (SELECT y AS class, n AS re, 0 AS sa, CASE WHEN y = p THEN n ELSE 0 END AS hit FROM c UNION ALL SELECT p, 0, n, 0 FROM c) GROUP BY 1),
 m AS (SELECT class, coalesce(hit / nullif(sa, 0), 0) AS precision, coalesce(hit / nullif(re, 0), 0) AS recall, re, sa, hit FROM k),
 f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)"""


def predictions(t):
    docs = t.documents.select("doc_id", (F.col("n_chars") > 300).cast("int").alias("p"))
    return t.labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), "p")


@query(
    "l5_classification_evaluation",
    f"""WITH {EVAL} SELECT 'confusion' AS metric, y || '>' || p AS class, n::DOUBLE AS value FROM c
       UNION ALL SELECT 'precision', class::VARCHAR, round(precision, 9) FROM f UNION ALL SELECT 'recall', class::VARCHAR, round(recall, 9) FROM f UNION ALL SELECT 'f1', class::VARCHAR, round(f1, 9) FROM f
       UNION ALL SELECT 'macro_precision', 'all', round(avg(precision), 9) FROM f UNION ALL SELECT 'macro_recall', 'all', round(avg(recall), 9) FROM f UNION ALL SELECT 'macro_f1', 'all', round(avg(f1), 9) FROM f
       UNION ALL SELECT 'accuracy', 'all', round(sum(hit) / sum(re), 9) FROM f UNION ALL SELECT 'micro_f1', 'all', round(sum(hit) / sum(sa), 9) FROM f""",
)
def _(t):
    return L.evaluate(predictions(t), "y", "p").withColumn("value", F.round("value", 9))


@query("l6_label_error_analysis", f"WITH {EVAL} SELECT y::BIGINT AS y, p, count(*) AS n, min(doc_id) AS example FROM j WHERE y <> p GROUP BY 1, 2")
def _(t):
    df = L.label_errors(predictions(t), "y", "p", "doc_id")
    return df.withColumn("y", F.col("y").cast("bigint"))


@query(
    "l7_dataset_labels",
    """WITH ls AS (SELECT DISTINCT 'lang_' || lang AS label FROM documents WHERE lang <> 'es'),
       rq AS (SELECT source AS request, CASE WHEN doc_id % 5 = 0 THEN 'lang_' || lang ELSE source || '_' || (n_chars // 200) END AS label FROM documents WHERE doc_id % 50 < 3 OR n_chars > 5000),
       ad AS (SELECT request, CASE WHEN count(*) FILTER (WHERE label IN (SELECT label FROM ls)) > 0 THEN 'LABEL_EXISTS' WHEN count(*) > count(DISTINCT label) THEN 'DUPLICATE_LABEL' ELSE 'ADDED' END AS status FROM rq GROUP BY 1),
       rm AS (SELECT request, CASE WHEN count(*) FILTER (WHERE label NOT IN (SELECT label FROM ls)) > 0 THEN 'UNKNOWN_LABEL' ELSE 'REMOVED' END AS status FROM rq GROUP BY 1)
       SELECT 'add' AS action, request AS name, status FROM ad UNION ALL SELECT 'remove', request, status FROM rm
       UNION ALL SELECT 'set', label, 'MEMBER' FROM (SELECT label FROM ls UNION SELECT label FROM rq WHERE request IN (SELECT request FROM ad WHERE status = 'ADDED'))
       UNION ALL SELECT 'record', 'labeled', count(*)::VARCHAR FROM documents WHERE lang <> 'es' UNION ALL SELECT 'record', 'unlabeled', count(*)::VARCHAR FROM documents WHERE lang = 'es'""",
)
def _(t):
    lang = F.concat(F.lit("lang_"), "lang")
    label_set = t.documents.where("lang <> 'es'").select(lang.alias("label")).distinct()
    other = F.concat("source", F.lit("_"), F.expr("n_chars div 200").cast("string"))
    requests = t.documents.where("doc_id % 50 < 3 OR n_chars > 5000").select(
        F.col("source").alias("request"), F.when(F.col("doc_id") % 5 == 0, lang).otherwise(other).alias("label")
    )
    added = L.add_labels(label_set, requests).select(F.lit("add").alias("action"), F.col("request").alias("name"), "status")
    removed = L.remove_labels(label_set, requests).select(F.lit("remove").alias("action"), F.col("request").alias("name"), "status")
    merged = L.merged_label_set(label_set, requests).select(F.lit("set").alias("action"), F.col("label").alias("name"), F.lit("MEMBER").alias("status"))
    records = L.dataset_records(t.documents.select("doc_id"), "doc_id", t.documents.select("doc_id", lang.alias("label")), label_set)
    counts = records.groupBy(F.when(F.col("is_labeled"), "labeled").otherwise("unlabeled").alias("name")).agg(F.count("*").cast("string").alias("status"))
    return added.unionByName(removed).unionByName(merged).unionByName(counts.select(F.lit("record").alias("action"), "name", "status"))


@query(
    "l8_cells_to_rows",
    """WITH i AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS c FROM pages), e AS (SELECT page_id, c, unnest(range(0, len(c))) AS i FROM i)
       SELECT page_id, (i // 3)::INTEGER AS "row", max(c[i + 1]) FILTER (WHERE i % 3 = 0) AS c0, max(c[i + 1]) FILTER (WHERE i % 3 = 1) AS c1, max(c[i + 1]) FILTER (WHERE i % 3 = 2) AS c2 FROM e GROUP BY 1, 2""",
)
def _(t):
    items = F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1))
    cells = t.pages.select("page_id", F.posexplode(items).alias("i", "text"))
    cells = cells.select("page_id", F.expr("i div 3").cast("int").alias("row"), (F.col("i") % 3).alias("col"), "text")
    return L.cells_to_table(cells, "page_id", "row", "col", "text", [0, 1, 2])


TOPICS = """{"topic": "glue", "keywords": ["of the", "und", "THE"]}, {"topic": "insult", "keywords": ["clown", "idiot"]}, {"topic": "romance", "keywords": ["de la", "que"]}"""


@query(
    "l9_topic_keywords",
    f"""WITH w AS (SELECT doc_id, {WORDS} AS t FROM documents), g AS (SELECT doc_id, unnest(t) AS phrase FROM w
       UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM w)),
       k AS (SELECT * FROM (VALUES ('glue', 'of the'), ('glue', 'und'), ('glue', 'THE'), ('insult', 'clown'), ('insult', 'idiot'), ('romance', 'de la'), ('romance', 'que')) v(topic, keyword))
       SELECT doc_id, topic, keyword, count(*) AS hits FROM g JOIN k ON phrase = lower(keyword) GROUP BY 1, 2, 3""",
)
def _(t):
    raw = t.spark.createDataFrame([(TOPICS,)], "raw string")
    topics = raw.select(F.explode(L.read_topics(F.col("raw"))).alias("t")).select("t.topic", F.explode("t.keywords").alias("keyword"))
    return L.keywords_for(t.documents, "doc_id", "text", topics)
