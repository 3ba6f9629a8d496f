"""Log mining: templates, outliers, anomalies, keywords, labels, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.plans.joining import null_safe_join, salted_join, share_of, split_join
from opsloom.plans.ordered import ordered_window, top_per_key
from opsloom.plans.predicates import to_column
from opsloom.plans.quantiles import exact_quantiles
from opsloom.plans.storage import cut_lineage
from opsloom.plans.timing import bucket, fill_gaps

# fixed values: variable parts of a message and the slot that stands for them, applied in this order
SLOTS = [
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<mail>"),
    ("https?://[^ ]+", "<url>"),
    ('"[^"]*"', "<text>"),
    ("[0-9]{1,3}([.][0-9]{1,3}){3}", "<ip>"),
    ("0x[0-9a-fA-F]+", "<hex>"),
    ("[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}", "<id>"),
    ("[0-9]+", "<n>"),
]


def template(col: Column) -> Column:
    for pattern, slot in SLOTS:
        col = F.regexp_replace(col, pattern, slot)
    return F.trim(F.regexp_replace(col, "[ \\t]+", " "))


def cluster(df: DataFrame, text: str) -> DataFrame:
    """Messages grouped by template, with count, share and smallest example."""
    rows = df.select(F.col(text).alias("line"), template(F.col(text)).alias("template"))
    groups = rows.groupBy("template").agg(F.count("*").alias("n"), F.min("line").alias("sample"))
    return groups.withColumn("template_id", F.md5(F.col("template").cast("binary")))


def outlier(df: DataFrame, by: list[str], col: str, k: float, method: str = "mad") -> DataFrame:
    """Rows far from their group: robust z over the median absolute deviation, or the IQR fence.

    The group statistics (one row per group) are written out, since they are met twice.
    """
    if method == "iqr":
        q = cut_lineage(exact_quantiles(df, by, col, {"_q1": 0.25, "_q3": 0.75}))
        rows = null_safe_join(df, q, by)
        iqr = F.col("_q3") - F.col("_q1")
        out = (F.col(col) < F.col("_q1") - k * iqr) | (F.col(col) > F.col("_q3") + k * iqr)
        return rows.where(out).drop("_q1", "_q3")
    mid = cut_lineage(exact_quantiles(df, by, col, {"_median": 0.5}))
    rows = null_safe_join(df, mid, by).withColumn("_dev", F.abs(F.col(col) - F.col("_median")))
    mad = cut_lineage(exact_quantiles(rows, by, "_dev", {"_mad": 0.5}))
    rows = null_safe_join(rows, mad, by)
    z = F.try_divide(0.6745 * (F.col(col) - F.col("_median")), F.col("_mad"))
    return rows.withColumn("robust_z", z).where(F.abs("robust_z") > k).drop("_median", "_dev", "_mad")


def anomaly(df: DataFrame, by: list[str], ts: str, span: str, measure: str, n: int, k: float) -> DataFrame:
    """Buckets outside rolling mean +/- k sigma of the n buckets before (needs all n)."""
    series = df.groupBy(*by, bucket(ts, span).alias("bucket")).agg(F.expr(measure).cast("double").alias("v"))
    return anomaly_points(fill_gaps(series, by, span, {"v": 0.0}), by, "bucket", "v", n, k)


def anomaly_points(series: DataFrame, by: list[str], slot: str, v: str, n: int, k: float) -> DataFrame:
    """The same on a ready series of one row per group and bucket."""
    w = Window.partitionBy(*by).orderBy(slot).rowsBetween(-n, -1)
    rows = series.withColumns({"mean": F.avg(v).over(w), "sigma": F.stddev_samp(v).over(w), "_n": F.count(v).over(w)})
    gap = F.round(F.abs(F.col(v) - F.col("mean")) - k * F.col("sigma"), 9)
    return rows.where((F.col("_n") == n) & (gap > 0)).drop("_n")


def classify(df: DataFrame, cols: list[str], common_share: float) -> DataFrame:
    """Value combinations flagged common or unusual.

    A combination is common while the strictly more frequent ones cover less than
    ``common_share`` of the rows.  Only the histogram of counts is ordered.
    """
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    hist = counts.groupBy("n").agg(F.sum("n").alias("_rows"))
    above = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_above", F.coalesce(F.sum("_rows").over(above), F.lit(0)))
    total = df.agg(F.count("*")).scalar()
    flag = F.when(F.col("_above") / total < common_share, "common").otherwise("unusual")
    return counts.join(hist, "n").select(*cols, "n", flag.alias("kind"))


def tokens(text: Column) -> Column:
    """Lower-case words of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))


def word_counts(df: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, word, tf``, counted within each row: equal words lie side by side in its sorted words, and no word is shuffled.

    Rows of one id are added up, which only ids of several rows pay for.
    """
    ids = df.groupBy(doc).agg(F.count("*").alias("_n"))
    repeated = cut_lineage(ids.where("_n > 1").select(doc))
    if not repeated.isEmpty():
        once = _counts_per_row(null_safe_join(df, repeated, [doc], "left_anti"), doc, text)
        more = _counts_per_row(null_safe_join(df, repeated, [doc], "left_semi"), doc, text)
        return once.unionByName(more.groupBy(doc, "word").agg(F.sum("tf").alias("tf")))
    return _counts_per_row(df, doc, text)


def _counts_per_row(df: DataFrame, doc: str, text: str) -> DataFrame:
    rows = df.select(doc, F.sort_array(tokens(F.col(text))).alias("_words")).where(F.size("_words") > 0)
    word = lambda i: F.get("_words", i)
    rows = rows.withColumn("_at", F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: (i == 0) | (word(i) != word(i - 1))))
    end = lambda k: F.coalesce(F.get("_at", k + 1), F.size("_words"))
    counted = F.transform("_at", lambda at, k: F.struct(word(at).alias("word"), (end(k) - at).cast("bigint").alias("tf")))
    return rows.select(doc, F.inline(counted))


def keywords(df: DataFrame, doc: str, text: str, n: int, stop_words: list[str], hot_rows: int = 1_000_000, hot_words: int = 50_000) -> DataFrame:
    """Top n words per document by tf x ln(documents / documents with the word).

    A word of more than ``hot_rows`` documents, and the ``hot_words`` most frequent ones, meet their
    counts where their postings are: a word of all documents is not one key of a shuffle, and of
    all words of a document that are frequent only the best n leave the task.
    """
    # read for the counts and for the scores, and far smaller than the texts
    tf = cut_lineage(word_counts(df, doc, text).where(~F.col("word").isin(stop_words)))
    spread = cut_lineage(tf.groupBy("word").agg(F.count("*").alias("df")))
    total = df.agg(F.count("*")).scalar()
    # only the histogram of counts is ordered; words of more documents than the limit are at most hot_words
    sizes = spread.groupBy("df").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_words", F.sum("_n").over(Window.orderBy(F.col("df").desc())))
    limit = sizes.where(F.col("_words") > hot_words).agg(F.max("df")).first()[0] or 0
    scored = split_join(tf, spread, "word", min(hot_rows, limit), "df").withColumn("score", F.round(F.col("tf") * F.ln(total / F.col("df")), 6))
    return top_per_key(scored, [doc], [F.col("score").desc(), F.col("word")], n)


def label(df: DataFrame, rules: list[tuple[object, str, int]]) -> DataFrame:
    """Rules are (condition, label, priority): all labels that hold, in rule order, and the highest priority."""
    named = F.array_compact(F.array(*[F.when(to_column(c), F.lit(name)) for c, name, _ in rules]))
    ranks = F.array_compact(F.array(*[F.when(to_column(c), F.lit(p)) for c, _, p in rules]))
    return df.withColumns({"labels": named, "priority": F.array_max(ranks)})


def ingest_rules(df: DataFrame, rules: list[tuple[str, object]], ts: str, span: str, value: str) -> DataFrame:
    """Condition -> derived metric: count and sum per rule and bucket; batch and stream frames alike."""
    hit = F.array_compact(F.array(*[F.when(to_column(c), F.lit(name)) for name, c in rules]))
    tagged = df.withColumn("rule", F.explode(hit))
    return tagged.groupBy(F.window(ts, span).alias("w"), "rule").agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def associations(logs: DataFrame, entities: DataFrame, on: str, source: str) -> DataFrame:
    """Per log source: records matched to an entity, unmatched, and distinct entities seen."""
    known = entities.select(on).distinct().withColumn("_known", F.lit(True))
    return (
        logs.join(known, on, "left")
        .groupBy(source)
        .agg(
            F.count_if(F.col("_known")).alias("matched"),
            F.count_if(F.col("_known").isNull()).alias("unmatched"),
            F.count_distinct(F.when(F.col("_known"), F.col(on))).alias("association_count"),
        )
    )


def pattern_report(df: DataFrame, col: str, patterns: dict[str, str]) -> DataFrame:
    """Matches per pattern and the rows no pattern matches, in one pass."""
    hits = {n: F.coalesce(F.col(col).rlike(p), F.lit(False)) for n, p in patterns.items()}
    named = F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h in hits.items()]))
    named = F.when(F.size(named) == 0, F.array(F.lit("unmatched"))).otherwise(named)
    counts = df.select(F.explode(named).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    return counts.withColumn("share", share_of(F.col("n"), df.agg(F.count("*")).scalar()))


def islands(df: DataFrame, by: list[str], start: str, end: str, key: str, chunk: Column) -> DataFrame:
    """Overlapping or touching ranges merged: start, end and number of members per island.

    A range opens an island when it starts after the largest end before it; an
    island ends with that largest end as seen by the next opener.
    """
    rows = ordered_window(
        df, by, [start, key], chunk, running={"_reach": ("max", F.col(end))}, number="_rn", exclusive=("_reach",)
    )
    opens = rows.where(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")))
    opens = ordered_window(opens, by, [start, key], chunk, lead={"_next_reach": "_reach", "_next_rn": "_rn"})
    whole = df.groupBy(*by).agg(F.max(end).alias("_last"), F.count("*").alias("_all"))
    out = null_safe_join(opens, whole, by)
    return out.select(
        *by,
        F.col(start).alias("island_start"),
        F.coalesce("_next_reach", "_last").alias("island_end"),
        (F.coalesce(F.col("_next_rn") - 1, F.col("_all")) - F.col("_rn") + 1).alias("members"),
    )


def overlap_pairs(df: DataFrame, by: list[str], start: str, end: str, key: str, salts: int = 8) -> DataFrame:
    """Every pair of overlapping ranges of a key once: ``by, first, second, overlap_start, overlap_end``.

    Ranges are half open; empty ones, and those without a bound, overlap nothing.  ``first`` starts
    before ``second`` (at the same time: has the smaller key).  A range of a length up to 2 ** n
    microseconds is entered in the two buckets at most of that width which it touches, and a start looks up its
    bucket of every width in use, so each pair meets once, at the later start, and what meets
    is of the order of what overlaps, however long some ranges are.  ``salts`` split a bucket's starts.
    """
    at = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
    # a struct as key, in which nulls are equal
    group = F.struct(F.lit(0).alias("_"), *by).alias("_by")
    rows = df.select(group, F.col(key).alias("_key"), at(start).alias("_from"), at(end).alias("_to"), F.col(start).alias("_start"), F.col(end).alias("_end"))
    rows = rows.where(F.col("_from") < F.col("_to")).withColumn("_level", F.ceil(F.log2((F.col("_to") - F.col("_from")).cast("double"))).cast("int"))
    rows = cut_lineage(rows)
    width = lambda level: F.pow(F.lit(2.0), level).cast("bigint")
    slot = lambda point, level: F.floor(point / width(level))
    # no more levels than bits in a length
    levels = [r[0] for r in rows.select("_level").distinct().collect()]
    if not levels:
        levels = [0]
    level = F.col("_level")
    spans = F.array_distinct(F.array(slot(F.col("_from"), level), slot(F.col("_to") - 1, level)))
    earlier = rows.select("_by", level, F.explode(spans).alias("_slot"), *(F.col(c).alias(f"{c}_a") for c in ("_key", "_from", "_to", "_end")))
    probes = F.explode(F.array(*[F.struct(F.lit(n).alias("_level"), slot(F.col("_from"), F.lit(n)).alias("_slot")) for n in levels]))
    later = rows.drop("_level").withColumn("_probe", probes).select("*", "_probe.*").drop("_probe")
    met = salted_join(later, earlier, ["_by", "_level", "_slot"], salts=salts, spread=["_key", "_from"])
    before = (F.col("_from_a") < F.col("_from")) | ((F.col("_from_a") == F.col("_from")) & (F.col("_key_a") < F.col("_key")))
    return met.where(before & (F.col("_to_a") > F.col("_from"))).select(
        *(F.col("_by")[c].alias(c) for c in by), F.col("_key_a").alias("first"), F.col("_key").alias("second"), F.col("_start").alias("overlap_start"), F.least("_end", "_end_a").alias("overlap_end")
    )


def overlap_counts(df: DataFrame, by: list[str], start: str, end: str, key: str, chunk_of) -> DataFrame:
    """How many other ranges of the key each range overlaps, without forming the pairs.

    Ranges are half open and not empty.  Those that overlap r are all that start
    before r ends, less those that ended when r starts, less r itself.
    """
    marks = F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("kind")), F.struct(F.col(end).alias("at"), F.lit(0).alias("kind"))
    )
    points = df.select(*by, key, F.explode(marks).alias("p")).select(*by, key, "p.*")
    counted = ordered_window(
        points, by, ["at", "kind", key], chunk_of("at"),
        running={"_starts": ("sum", (F.col("kind") == 1).cast("long")), "_ends": ("sum", (F.col("kind") == 0).cast("long"))},
    )
    # at equal times ends come first, so an end sees no start at its own time and a start sees every end there
    return counted.groupBy(*by, key).agg(
        (F.max(F.when(F.col("kind") == 0, F.col("_starts"))) - F.max(F.when(F.col("kind") == 1, F.col("_ends"))) - 1).alias("overlaps")
    )
