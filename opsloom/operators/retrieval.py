"""Ranking, chunking, guardrails and conversation usage; vector search is in ``vectors``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators.logs import tokens
from opsloom.operators.text import PII, count_known
from opsloom.plans.joining import split_join
from opsloom.plans.ordered import ordered_window, top_per_key
from opsloom.plans.storage import cut_lineage

#: Query words up to this number are sent to every task that reads documents.
VOCABULARY = 500_000


def mean_vectors(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean vector per group, added up position by position."""
    parts = vectors.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    points = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return parts.groupBy(by).agg(points.alias(vector))


def rerank(
    pairs: DataFrame, queries: DataFrame, docs: DataFrame, query: str, doc: str, text: str, k: int, k1: float = 1.2, b: float = 0.75, hot_rows: int = 1_000_000
) -> DataFrame:
    """Candidate pairs (query, doc) ranked by BM25, with statistics of all documents; k per query.

    Words that occur in no query are dropped before they are counted, or, if the queries hold
    too many words to send around, after.  Postings meet the pairs by document; by term they meet
    only the number of its documents, and a term of more than ``hot_rows`` documents does so in place.
    """
    terms = queries.select(query, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    vocabulary = cut_lineage(terms.select("term").distinct())
    words = docs.select(doc, tokens(F.col(text)).alias("_t")).withColumn("len", F.size("_t"))
    found = words.select(doc, "len", F.explode("_t").alias("term"))
    if vocabulary.count() <= VOCABULARY:
        found = found.join(F.broadcast(vocabulary), "term", "left_semi")
    # read twice below, and far smaller than the texts
    tf = cut_lineage(found.groupBy(doc, "term", "len").agg(F.count("*").alias("tf")))
    spread = cut_lineage(tf.groupBy("term").agg(F.count("*").alias("df")).join(vocabulary, "term", "left_semi"))
    corpus = words.agg(F.struct(F.count("*").alias("n"), F.avg("len").alias("mean"))).scalar()
    postings = split_join(tf, spread, "term", hot_rows, "df")
    hits = pairs.select(query, doc).distinct().join(postings, doc).join(terms, [query, "term"])
    idf = F.ln(1 + (corpus["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / corpus["mean"]))
    scored = hits.groupBy(query, doc).agg(F.round(F.sum(idf * weight), 6).alias("score"))
    return top_per_key(scored, [query], [F.col("score").desc(), F.col(doc)], k)


def shared_phrases(queries: DataFrame, docs: DataFrame, query: str, doc: str, text: str, n: int) -> DataFrame:
    """Pairs that share a run of n words: equality on the 64-bit hash of the run."""

    def runs(df: DataFrame, key: str) -> DataFrame:
        """One row per run: the word list beside its own shifts, cut where the last shift ends."""
        words = df.select(key, tokens(F.col(text)).alias("_t")).where(F.size("_t") >= n)
        count = F.size("_t") - n + 1
        shifts = F.arrays_zip(*[F.slice("_t", F.lit(i + 1), count).alias(f"w{i}") for i in range(n)])
        rows = words.select(key, F.explode(shifts).alias("r"))
        return rows.select(key, F.xxhash64(*[F.col("r")[f"w{i}"] for i in range(n)]).alias("_run"))

    asked = runs(queries, query).distinct()
    return runs(docs, doc).join(asked, "_run").select(query, doc).distinct()


def chunk(df: DataFrame, key: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """Text cut into pieces of ``size`` characters that share ``overlap``; the whole text is covered."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    n = F.length(text)
    last = F.greatest(F.ceil((n - overlap) / step).cast("int") - 1, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))
    return df.where(n > 0).select(*key, F.posexplode(pieces).alias("chunk_no", "chunk"))


# fixed values: rules of a prompt injection score, (pattern, weight); a score is their sum, at most 1
INJECTION_RULES = [
    ("(?i)ignore (all|any|the) (previous|above)", 0.6),
    ("(?i)system prompt", 0.5),
    ("(?i)you are now", 0.4),
    ("(?i)(token|password|secret) *=", 0.5),
    ("[!]{2,}", 0.2),
    ("[A-Za-z0-9+/]{40,}", 0.3),
    ("<[|]?(system|im_start)[|]?>", 0.6),
]


def injection_score(text: Column, rules: list[tuple[str, float]] = INJECTION_RULES) -> Column:
    total = F.lit(0.0)
    for pattern, weight in rules:
        total = total + F.when(text.rlike(pattern), F.lit(weight)).otherwise(0.0)
    return F.round(F.least(total, F.lit(1.0)), 6)


# fixed values: words per moderation category
MODERATION = {
    "INSULT": ["idiot", "moron", "clown", "loser", "stupid"],
    "HATE": ["scum", "trash", "disgusting", "worthless", "pathetic"],
}


def category_score(words: str, category: str) -> Column:
    """Share of category words in a column of words, times 20, at most 1."""
    return F.round(F.least(count_known(words, MODERATION[category]) * 20.0 / F.greatest(F.size(words), F.lit(1)), F.lit(1.0)), 6)


def category_scores(df: DataFrame, text: str, categories: list[str]) -> DataFrame:
    """One column per category, from words that are cut once."""
    rows = df.withColumn("_w", tokens(F.col(text)))
    return rows.withColumns({f"_s_{c}": category_score("_w", c) for c in categories}).drop("_w")


def moderate(df: DataFrame, text: str, categories: list[str] | None = None) -> DataFrame:
    """Score per asked category, as one row per document and category with a hit, plus OVERALL for the highest."""
    asked = categories or list(MODERATION)
    rows = category_scores(df, text, asked)
    scores = [F.struct(F.lit(c).alias("category"), F.col(f"_s_{c}").alias("score")) for c in asked]
    highest = F.greatest(*[F.col(f"_s_{c}") for c in asked], F.lit(0.0))
    overall = F.struct(F.lit("OVERALL").alias("category"), highest.alias("score"))
    others = [c for c in df.columns if c != text]
    return rows.select(*others, F.explode(F.array(*scores, overall)).alias("m")).select(*others, "m.*")


def guardrails(df: DataFrame, text: str, pii_types: list[str] | None = None) -> DataFrame:
    """Moderation, personal data and injection results as one struct."""
    col = F.col(text)
    rows = category_scores(df, text, list(MODERATION))
    worst = F.greatest(*[F.col(f"_s_{c}") for c in MODERATION])
    kinds = F.array_compact(F.array(*[F.when(col.rlike(PII[t]), F.lit(t)) for t in pii_types or list(PII)]))
    bundle = F.struct(worst.alias("moderation"), kinds.alias("pii"), injection_score(col).alias("injection"))
    return rows.withColumn("guardrail", bundle).select(*df.columns, "guardrail")


def session_usage(df: DataFrame, session: str, role: str, text: str) -> DataFrame:
    """Turns and words per session, in total and per role."""
    words = F.size(F.filter(F.split(F.col(text), "[ \\n]+"), lambda w: w != ""))
    counted = df.select(session, role, words.alias("words"))
    return counted.groupBy(session).agg(
        F.count("*").alias("turns"), F.sum("words").alias("words"),
        *[x for r in ("user", "assistant", "system") for x in (
            F.count_if(F.col(role) == r).alias(f"{r}_turns"), F.sum(F.when(F.col(role) == r, F.col("words")).otherwise(0)).alias(f"{r}_words"))],
    )


def prompt_pairs(df: DataFrame, session: str, turn: str, role: str, text: str) -> DataFrame:
    """Each user turn that an assistant turn follows directly, as one JSON record of prompt and completion."""
    rows = ordered_window(
        df, [session], [turn], F.floor(F.col(turn) / 1000), lead={"_role": role, "_text": text}
    ).where((F.col(role) == "user") & (F.col("_role") == "assistant"))
    record = F.to_json(F.struct(F.col(text).alias("prompt"), F.col("_text").alias("completion")))
    return rows.select(session, turn, record.alias("record"))
