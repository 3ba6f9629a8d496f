"""Queries of the retrieval and guardrail family."""

from pyspark.sql import functions as F

from opsloom.catalog.registry import query
from opsloom.catalog.text import WORDS, in_list
from opsloom.operators import retrieval as G
from opsloom.operators import vectors as V
from opsloom.operators.text import PII
from opsloom.plans.predicates import Cond

CENTROIDS = """c AS (SELECT label, list(x ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(embedding[pos]::DOUBLE) AS x FROM
 (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


def centroids(t):
    """One query vector per label: the mean of its vectors."""
    return G.mean_vectors(t.embeddings, "label", "embedding").withColumnRenamed("label", "query_id")


def nearest_sql(where=""):
    scores = f"""SELECT 'cosine' AS metric, c.label AS query_id, vec_id, round(list_cosine_similarity(centroid, embedding::DOUBLE[]), 9) AS score FROM c, embeddings e {where}
     UNION ALL SELECT 'dot', c.label, vec_id, round(list_inner_product(centroid, embedding::DOUBLE[]), 9) FROM c, embeddings e {where}
     UNION ALL SELECT 'l2', c.label, vec_id, round(-list_distance(centroid, embedding::DOUBLE[]), 9) FROM c, embeddings e {where}"""
    return f"""WITH {CENTROIDS}, s AS ({scores}), r AS (SELECT *, row_number() OVER (PARTITION BY metric, query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
     SELECT metric, query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5"""


def ranked(parts):
    out = None
    for metric, df in parts.items():
        df = df.select(F.lit(metric).alias("metric"), "query_id", "vec_id", "rank", F.round("score", 6).alias("score"))
        out = df if out is None else out.unionByName(df)
    return out


@query("g1_vector_top_k", nearest_sql())
def _(t):
    return ranked({m: V.nearest(centroids(t), t.embeddings, 5, m) for m in ("cosine", "dot", "l2")})


def indexed_sql(bands=20, bits=8, dim=64):
    """Codes by signed sums, buckets that differ in one bit at most, exact cosine of what meets."""
    sign = "CASE WHEN substr(md5('plane|' || band || '|' || bit || '|' || d), 1, 1) < '8' THEN 1.0 ELSE -1.0 END"
    code = lambda key, v, table: f"SELECT {key}, band, sum(CASE WHEN list_inner_product({v}::DOUBLE[], plane) > 0 THEN 1 << bit ELSE 0 END)::BIGINT AS code FROM {table}, p GROUP BY 1, 2"
    return f"""{CENTROIDS}, p AS (SELECT band, bit, list({sign}::DOUBLE ORDER BY d) AS plane FROM range({bands}) b(band), range({bits}) k(bit), range({dim}) t(d) GROUP BY 1, 2),
     vc AS ({code('vec_id', 'embedding', 'embeddings')}), qc AS ({code('label', 'centroid', 'c')}),
     met AS (SELECT DISTINCT label, vec_id FROM qc JOIN vc USING (band) WHERE bit_count(xor(qc.code, vc.code)) <= 1),
     s AS (SELECT c.label AS query_id, e.vec_id, round(list_cosine_similarity(centroid, embedding::DOUBLE[]), 9) AS score, met.vec_id IS NOT NULL AS met FROM c CROSS JOIN embeddings e LEFT JOIN met ON met.label = c.label AND met.vec_id = e.vec_id)"""


def top_sql(where, k):
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s {where}) WHERE rank <= {k}"


@query("g2_approximate_top_k", f"WITH {indexed_sql()} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM ({top_sql('WHERE met', 5)})")
def _(t):
    df = V.nearest_approx(centroids(t), t.embeddings, 5)
    return df.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(
    "g2_index_recall",
    f"""WITH {indexed_sql()}, e AS ({top_sql('', 10)}), a AS ({top_sql('WHERE met', 10)})
       SELECT count(*) AS wanted, count(a.vec_id) AS found, count(a.vec_id) >= 0.9 * count(*) AS enough FROM e LEFT JOIN a ON e.query_id = a.query_id AND e.vec_id = a.vec_id""",
)
def _(t):
    """How many of the exact 10 nearest of each query the index finds."""
    exact = V.nearest(centroids(t), t.embeddings, 10).select("query_id", "vec_id")
    found = V.nearest_approx(centroids(t), t.embeddings, 10).select("query_id", "vec_id", F.lit(1).alias("one"))
    counted = exact.join(found, ["query_id", "vec_id"], "left").agg(F.count("*").alias("wanted"), F.count("one").alias("found"))
    return counted.withColumn("enough", F.col("found") >= 0.9 * F.col("wanted"))


PHRASES = f"""dw AS (SELECT doc_id, {WORDS} AS w FROM documents), qw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
 dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM dw)),
 qr AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM qw)),
 pairs AS (SELECT DISTINCT item_id, doc_id FROM qr JOIN dr USING (run))"""


@query(
    "g3_rerank_bm25",
    f"""WITH {PHRASES}, terms AS (SELECT DISTINCT item_id, unnest(w) AS term FROM qw), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM dw) GROUP BY 1, 2),
       df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM dw),
       s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))), 6) AS score
       FROM pairs JOIN terms USING (item_id) JOIN tf USING (doc_id, term) JOIN df USING (term) JOIN dw USING (doc_id), n GROUP BY 1, 2)
       SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 3""",
)
def _(t):
    items = t.benchmark.select("item_id", "text")
    pairs = G.shared_phrases(items, t.documents, "item_id", "doc_id", "text", 8)
    return G.rerank(pairs, items, t.documents, "item_id", "doc_id", "text", 3)


@query("g4_filtered_retrieval", nearest_sql("WHERE e.label >= 5") + " AND metric = 'cosine'")
def _(t):
    return ranked({"cosine": V.retrieve(centroids(t), t.embeddings, Cond("label", ">=", 5), 5)})


@query(
    "g5_chunking",
    """SELECT doc_id, i::INTEGER AS chunk_no, substr(text, (i * 450 + 1)::BIGINT, 500) AS chunk FROM
       (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 50) / 450.0)::BIGINT, 1))) AS i FROM documents WHERE length(text) > 0)""",
)
def _(t):
    return G.chunk(t.documents, ["doc_id"], "text", 500, 50)


def injection_sql(col):
    return "round(least(" + " + ".join(f"CASE WHEN regexp_matches({col}, '{p}') THEN {w}::DOUBLE ELSE 0.0 END" for p, w in G.INJECTION_RULES) + ", 1.0), 6)::DOUBLE"


@query(
    "g6_prompt_injection_score",
    f"""SELECT 'turn' AS kind, conv_id * 1000 + turn AS id, {injection_sql('text')} AS score FROM conversations
       UNION ALL SELECT 'document', doc_id, {injection_sql('text')} FROM documents""",
)
def _(t):
    turns = t.conversations.select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    docs = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return turns.unionByName(docs).select("kind", "id", G.injection_score(F.col("text")).alias("score"))


def category_sql(name):
    return f"round(least(len(list_filter(w, lambda x: x IN ({in_list(G.MODERATION[name])}))) * 20.0::DOUBLE / greatest(len(w), 1), 1.0), 6)::DOUBLE"


@query(
    "g7_content_moderation",
    f"""WITH m AS (SELECT doc_id, {category_sql('INSULT')} AS a, {category_sql('HATE')} AS b FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
       l AS (SELECT doc_id, 'INSULT' AS category, a AS score FROM m UNION ALL SELECT doc_id, 'HATE', b FROM m UNION ALL SELECT doc_id, 'OVERALL', greatest(a, b) FROM m)
       SELECT doc_id, category, score, toxic::BIGINT AS toxic FROM l LEFT JOIN labels USING (doc_id)""",
)
def _(t):
    scores = G.moderate(t.documents.select("doc_id", "text"), "text")
    return scores.join(t.labels.select("doc_id", F.col("toxic").cast("bigint").alias("toxic")), "doc_id", "left")


@query(
    "g8_guardrail_bundle",
    f"""SELECT conv_id, turn, greatest({category_sql('INSULT')}, {category_sql('HATE')}) AS moderation, concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in PII.items())}) AS pii,
       {injection_sql('text')} AS injection FROM (SELECT *, {WORDS} AS w FROM conversations)""",
)
def _(t):
    df = G.guardrails(t.conversations, "text")
    return df.select(
        "conv_id", "turn", F.col("guardrail.moderation").alias("moderation"), F.array_join("guardrail.pii", ",").alias("pii"),
        F.col("guardrail.injection").alias("injection"),
    )


@query(
    "g9_session_usage",
    """WITH w AS (SELECT conv_id, role, len(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '')) AS words FROM conversations)
       SELECT conv_id, count(*) AS turns, sum(words)::BIGINT AS words, count(*) FILTER (WHERE role = 'user') AS user_turns, coalesce(sum(words) FILTER (WHERE role = 'user'), 0)::BIGINT AS user_words,
       count(*) FILTER (WHERE role = 'assistant') AS assistant_turns, coalesce(sum(words) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS assistant_words,
       count(*) FILTER (WHERE role = 'system') AS system_turns, coalesce(sum(words) FILTER (WHERE role = 'system'), 0)::BIGINT AS system_words FROM w GROUP BY 1""",
)
def _(t):
    return G.session_usage(t.conversations, "conv_id", "role", "text")


@query(
    "g10_prompt_completion_pairs",
    """WITH p AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
       SELECT conv_id, turn, '{"prompt":' || to_json(text) || ',"completion":' || to_json(t2) || '}' AS record FROM p WHERE role = 'user' AND r2 = 'assistant'""",
)
def _(t):
    return G.prompt_pairs(t.conversations, "conv_id", "turn", "role", "text")
