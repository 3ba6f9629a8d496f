"""Text and label jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators.logs import tokens
from opsloom.operators.privacy import hash_number

# fixed values: frequent function words per language
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "a", "is", "that", "it", "for", "was", "with", "by", "this", "are", "from"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "ist", "nicht", "dem", "im", "eine"],
    "fr": ["le", "et", "les", "des", "du", "une", "pour", "est", "qui", "par", "dans", "sur", "au", "pas", "avec"],
    "es": ["el", "y", "los", "se", "del", "las", "por", "no", "con", "su", "una", "es", "para", "al", "lo"],
}


def count_known(words: str, known: list[str]) -> Column:
    """How many entries of an array column are in a list."""
    return F.size(F.filter(words, lambda w: w.isin(known)))


def detect_language(df: DataFrame, text: str, words: dict[str, list[str]] = FUNCTION_WORDS) -> DataFrame:
    """Share of function words per language and the best one; ``und`` when no word is known.

    The word lists are part of the expression, so the rows are neither exploded nor shuffled.
    """
    rows = df.withColumn("_t", tokens(F.col(text)))
    size = F.greatest(F.size("_t"), F.lit(1))
    langs = sorted(words)
    for lang in langs:
        rows = rows.withColumn(f"score_{lang}", count_known("_t", words[lang]) / size)
    best = F.greatest(*[F.col(f"score_{x}") for x in langs])
    name = F.when(best == 0, "und")
    for lang in langs:
        name = name.when(F.col(f"score_{lang}") == best, lang)
    return rows.withColumns({"language": name, "score": best}).drop("_t")


# fixed values: personal data types found in free text
PII = {
    "EMAIL": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "URL": "https?://[A-Za-z0-9./?=&_%#-]+",
    "IP": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])[.]){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
    "CARD": r"\b(?:[0-9]{4}[- ]?){3}[0-9]{4}\b",
    "PHONE": "[+][0-9]{1,3} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}",
}


def luhn_ok(digits: Column) -> Column:
    """Check digit test over a string of digits, from the right, every second digit doubled."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    parts = F.transform(
        values, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    )
    total = F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def is_card(entity: Column) -> Column:
    return luhn_ok(F.regexp_replace(entity, "[- ]", ""))


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """Pieces between the matches, and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (offset, text) per match; offsets count characters from 0."""
    pieces, hits = _matches(text, pattern)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,text:string>>").alias("out"))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["piece"]) + F.length(p["hit"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(p["piece"])).alias("offset"), p["hit"].alias("text")))).alias("out"),
    )
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"]))


def detect_pii(df: DataFrame, key: list[str], text: str, types: dict[str, str] = PII) -> DataFrame:
    """One row per entity: type, offset, length, text; card numbers must pass their check digit."""
    def entities(name: str, pattern: str) -> Column:
        tag = lambda s: F.struct(F.lit(name).alias("type"), s["offset"].alias("offset"), s["text"].alias("entity"))
        return F.transform(spans_of(F.col(text), pattern), tag)

    per_type = [entities(name, pattern) for name, pattern in types.items()]
    found = F.concat(*[F.coalesce(a, F.array().cast("array<struct<type:string,offset:int,entity:string>>")) for a in per_type])
    rows = df.select(*key, F.explode(found).alias("p")).select(*key, "p.*")
    rows = rows.where((F.col("type") != "CARD") | is_card(F.col("entity")))
    return rows.withColumn("length", F.length("entity"))


# fixed values: stand-ins of the same kind for RELEXIFY
STAND_INS = {
    "EMAIL": ["anna@example.com", "ben@example.org", "cara@example.net"],
    "URL": ["https://example.com/a", "https://example.org/b"],
    "IP": ["192.0.2.1", "198.51.100.7", "203.0.113.9"],
    "CARD": ["0000000000000000"],
    "PHONE": ["+1 (555) 555-0100", "+1 (555) 555-0199"],
}


def rewrite_matches(text: Column, pattern: str, change) -> Column:
    """Text with every match replaced by ``change(match)``."""
    pieces, hits = _matches(text, pattern)
    parts = F.zip_with(pieces, F.transform(hits, change), lambda p, h: F.concat(p, F.coalesce(h, F.lit(""))))
    return F.when(F.size(hits) > 0, F.array_join(parts, "")).otherwise(text)


def mask_pii(
    df: DataFrame, text: str, mode: str, types: dict[str, str] = PII, exclude: list[str] | None = None,
    keep_last: int = 0, masking_char: str = "*", out: str | None = None, seed: str = "s",
) -> DataFrame:
    """REPLACE by the type name, MASK all but the last characters, REMOVE, or RELEXIFY by a value of the same type.

    What the finder does not report, such as a number that fails the check digit of cards, stays as it is in every mode.
    """

    def changed(name: str, m: Column) -> Column:
        if mode == "REPLACE":
            new = F.lit(f"<{name}>")
        elif mode == "REMOVE":
            new = F.lit("")
        elif mode == "MASK":
            rest = F.right(m, F.lit(keep_last)) if keep_last else F.lit("")
            new = F.concat(F.repeat(F.lit(masking_char), F.greatest(F.length(m) - keep_last, F.lit(0))), rest)
        elif mode == "RELEXIFY":
            pool = STAND_INS[name]
            new = F.element_at(F.array(*[F.lit(v) for v in pool]), (hash_number(seed, m, len(pool)) + 1).cast("int"))
        else:
            raise ValueError(f"unknown mode {mode!r}")
        return F.when(is_card(m), new).otherwise(m) if name == "CARD" else new

    rows, kept = df.withColumn("_text", F.col(text)), [c for c in types if c not in (exclude or [])]
    for name in kept:  # a step per type, so that no expression holds the one before it several times
        rows = rows.withColumn("_text", rewrite_matches(F.col("_text"), types[name], lambda m: changed(name, m)))
    col = F.col("_text")
    return rows.withColumn(out or text, col).drop("_text")


def with_errors(df: DataFrame, text: str, min_chars: int = 1, max_chars: int | None = None) -> DataFrame:
    """Bad documents stay, with an error code."""
    n = F.length(F.trim(F.col(text)))
    code = F.when(F.col(text).isNull() | (n == 0), "EMPTY").when(n < min_chars, "TOO_SHORT")
    if max_chars:
        code = code.when(n > max_chars, "TOO_LONG")
    code = code.when(~F.lower(F.col(text)).rlike("[a-zà-öø-ÿ]"), "NO_LETTERS")
    return df.withColumn("error", code)


def evaluate(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Confusion counts and scores in long form: (metric, class, value).

    Everything after the first grouping runs on one row per pair of classes.
    """
    pairs = df.groupBy(F.col(y).cast("string").alias("y"), F.col(yhat).cast("string").alias("p")).agg(F.count("*").alias("n"))
    confusion = pairs.select(F.lit("confusion").alias("metric"), F.concat_ws(">", "y", "p").alias("class"), F.col("n").cast("double").alias("value"))
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("real"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("real"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")),
    )
    per = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("class").agg(
        F.sum("real").alias("real"), F.sum("said").alias("said"), F.sum("hit").alias("hit")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("hit", "said"), zero)
    recall = F.coalesce(F.try_divide("hit", "real"), zero)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)
    per = per.withColumns({"precision": precision, "recall": recall, "f1": f1})
    names = ["precision", "recall", "f1"]
    by_class = per.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("class"), F.col(m).alias("value")) for m in names])).alias("r")).select("r.*")
    overall = per.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in names], (F.sum("hit") / F.sum("real")).alias("accuracy"), (F.sum("hit") / F.sum("said")).alias("micro_f1")
    )
    cells = [F.struct(F.lit(m).alias("metric"), F.lit("all").alias("class"), F.col(m).alias("value")) for m in overall.columns]
    return confusion.unionByName(by_class).unionByName(overall.select(F.explode(F.array(*cells)).alias("r")).select("r.*"))


def label_errors(df: DataFrame, y: str, yhat: str, key: str) -> DataFrame:
    """Wrongly labelled records per pair of classes, with the smallest key as an example."""
    wrong = df.where(~F.col(y).eqNullSafe(F.col(yhat)))
    return wrong.groupBy(y, yhat).agg(F.count("*").alias("n"), F.min(key).alias("example"))


def dataset_records(source: DataFrame, key: str, labels: DataFrame, label_set: DataFrame) -> DataFrame:
    """Records with their label; a label outside the set counts as unlabeled.  ``labels`` is (key, label)."""
    known = labels.join(label_set, "label", "left_semi")
    return source.join(known, key, "left").withColumn("is_labeled", F.col("label").isNotNull())


def add_labels(label_set: DataFrame, requests: DataFrame) -> DataFrame:
    """Status per request (request, label): a request with a label twice, or already in the set, is rejected."""
    marks = requests.join(label_set.withColumn("_known", F.lit(True)), "label", "left")
    per = marks.groupBy("request").agg(
        F.count("*").alias("_n"), F.count_distinct("label").alias("_d"), F.count_if(F.col("_known")).alias("_old")
    )
    why = F.when(F.col("_old") > 0, "LABEL_EXISTS").when(F.col("_n") > F.col("_d"), "DUPLICATE_LABEL").otherwise("ADDED")
    return per.select("request", why.alias("status"))


def remove_labels(label_set: DataFrame, requests: DataFrame) -> DataFrame:
    """Status per request: a request that names an unknown label is rejected."""
    marks = requests.join(label_set.withColumn("_known", F.lit(True)), "label", "left")
    per = marks.groupBy("request").agg(F.count_if(F.col("_known").isNull()).alias("_new"))
    return per.select("request", F.when(F.col("_new") > 0, "UNKNOWN_LABEL").otherwise("REMOVED").alias("status"))


def merged_label_set(label_set: DataFrame, requests: DataFrame, add: bool = True) -> DataFrame:
    """The label set after the accepted requests."""
    status = add_labels(label_set, requests) if add else remove_labels(label_set, requests)
    accepted = requests.join(status.where(F.col("status").isin("ADDED", "REMOVED")), "request", "left_semi").select("label")
    return label_set.unionByName(accepted).distinct() if add else label_set.join(accepted, "label", "left_anti")


def cells_to_table(df: DataFrame, table: str, row: str, col: str, text: str, columns: list[int]) -> DataFrame:
    """Cells (table, row, col, text) to one row per table row, one column per cell position."""
    picks = [F.max(F.when(F.col(col) == c, F.col(text))).alias(f"c{c}") for c in columns]
    return df.groupBy(table, row).agg(*picks)


def read_topics(text: Column) -> Column:
    """Topics from objects joined by commas (no surrounding brackets)."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<struct<topic:string,keywords:array<string>>>")


def keywords_for(df: DataFrame, key: str, text: str, topics: DataFrame) -> DataFrame:
    """Topic keywords found in each document, in any case and as whole words.

    ``topics`` is (topic, keyword).  Documents and keywords meet on the first
    word of the keyword, and the words after it are compared in place.
    """
    words = topics.select("topic", "keyword", tokens(F.col("keyword")).alias("_k")).where(F.size("_k") > 0)
    longest = words.agg(F.max(F.size("_k"))).first()[0]
    words = words.withColumn("_first", F.col("_k")[0])
    rows = df.select(key, tokens(F.col(text)).alias("_t"))
    # each word beside the ones that follow it; past the end the followers are null
    shifts = F.arrays_zip(*[F.slice("_t", F.lit(i + 1), F.greatest(F.size("_t"), F.lit(1))).alias(f"w{i}") for i in range(longest or 1)])
    runs = rows.select(key, F.explode(shifts).alias("_r"))
    met = runs.join(words, F.col("_r.w0") == F.col("_first"))
    for i in range(1, longest or 1):
        met = met.where((F.size("_k") <= i) | (F.get("_k", F.lit(i)) == F.col(f"_r.w{i}")))
    return met.groupBy(key, "topic", "keyword").agg(F.count("*").alias("hits"))
