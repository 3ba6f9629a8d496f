"""Aggregation, buckets, pivots, profiles and analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.plans.joining import null_safe_join, share_of
from opsloom.plans.ordered import ordered_window, rank_by_value, top_per_key
from opsloom.plans.predicates import first_match, to_column
from opsloom.plans.quantiles import exact_quantiles
from opsloom.plans.storage import cut_lineage
from opsloom.plans.timing import bucket as time_bucket
from opsloom.plans.timing import fill_gaps


def aggregate(df: DataFrame, by: list[str], aggs: dict[str, str | Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in aggs.items()])


SIMPLE = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp,
    "distinct": F.count_distinct,
}


def stats(
    df: DataFrame, by: list[str], specs: list[tuple[str, str, str]], order: list[str] | None = None, approx: bool = False
) -> DataFrame:
    """Statistics per group; each spec is (kind, column, output name).

    kinds: count sum avg min max stddev distinct first last median pNN.  first and
    last follow ``order``.  Quantiles are exact and never gather a group;
    ``approx=True`` takes sketches for distinct and quantiles instead.
    """
    aggs, exact = [], {}
    for kind, col, out in specs:
        p = 0.5 if kind == "median" else float(kind[1:]) / 100 if kind[0] == "p" and kind[1:].isdigit() else None
        if p is not None:
            if approx:
                aggs.append(F.percentile_approx(col, p).alias(out))
            else:
                exact.setdefault(col, {})[out] = p
        elif kind == "distinct" and approx:
            aggs.append(F.approx_count_distinct(col).alias(out))
        elif kind in ("first", "last"):
            pick = F.min_by if kind == "first" else F.max_by
            aggs.append(pick(col, F.struct(*order)).alias(out))
        else:
            aggs.append(SIMPLE[kind](col).alias(out))
    out = df.groupBy(*by).agg(*(aggs or [F.count("*").alias("_n")]))
    for col, probs in exact.items():
        out = null_safe_join(out, exact_quantiles(df, by, col, probs), by, "left")
    return out.select(*by, *[name for _, _, name in specs])


def distinct_values(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Distinct values per group as rows, so that no group is gathered into one array."""
    return df.select(*by, col).distinct()


def timestats(
    df: DataFrame, ts: str, span: str, aggs: dict[str, str], by: list[str] | None = None, fill: dict | None = None
) -> DataFrame:
    """Regular time buckets; with ``fill`` the empty ones are added per group."""
    by = by or []
    series = df.groupBy(*by, time_bucket(ts, span).alias("bucket")).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
    return fill_gaps(series, by, span, fill) if fill is not None else series


def geostats(
    df: DataFrame, aggs: dict[str, str], lat: str | None = None, lon: str | None = None, step: float = 10.0,
    place: str | None = None,
) -> DataFrame:
    """Aggregates per grid cell of ``step`` degrees, or per place name."""
    if place:
        return aggregate(df, [place], aggs)
    cell = lambda c: (F.floor(F.col(c) / step) * step).cast("double")
    return df.groupBy(cell(lat).alias("cell_lat"), cell(lon).alias("cell_lon")).agg(
        *[F.expr(e).alias(n) for n, e in aggs.items()]
    )


def distinct(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return (df.select(*cols) if cols else df).distinct()


def dedup(df: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first n rows per key; map tasks keep n rows per key before the shuffle."""
    return top_per_key(df, keys, [F.col(o) for o in order], n, "_rn").drop("_rn")


def dedup_consecutive(df: DataFrame, by: list[str], keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Keep a row unless the previous row of ``by`` has the same keys."""
    marked = ordered_window(df.withColumn("_has", F.lit(1)), by, order, chunk, lag={"_had": "_has", **{f"_p_{k}": k for k in keys}})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in keys])
    return marked.where(F.col("_had").isNull() | ~same).select(*df.columns)


def bucket(
    df: DataFrame, col: str, out: str, ranges: list[tuple[str, float | None, float | None]] | None = None,
    span: float | None = None, bounds: tuple[float, float, int] | None = None, default: str = "other",
) -> DataFrame:
    """Labelled ranges [low, high), or the floor to a span, or n equal buckets between bounds."""
    c = F.col(col)
    if ranges:
        rules = []
        for label, low, high in ranges:
            cond = F.lit(True) if low is None else c >= low
            rules.append((cond if high is None else cond & (c < high), label))
        return df.withColumn(out, first_match(rules, default))
    if span:
        return df.withColumn(out, F.floor(c / span) * span)
    low, high, n = bounds
    return df.withColumn(out, F.width_bucket(c, F.lit(low), F.lit(high), F.lit(n)))


def top(df: DataFrame, n: int, measure: str, key: list[str], by: list[str] | None = None, bottom: bool = False) -> DataFrame:
    """n largest (or smallest) rows by a measure, overall or per group; ties by key."""
    order = [F.col(measure).asc() if bottom else F.col(measure).desc(), *[F.col(k) for k in key]]
    if by:
        return top_per_key(df, by, order, n, "_rn").drop("_rn")
    return df.orderBy(*order).limit(n)


def frequent(df: DataFrame, cols: list[str], n: int, by: list[str] | None = None, rare: bool = False) -> DataFrame:
    """Most (or least) frequent value combinations with count and share of the group; the rows are counted once, here."""
    by = by or []
    counts = cut_lineage(df.groupBy(*by, *cols).agg(F.count("*").alias("n")))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
        counts = null_safe_join(counts, totals, by)
        counts = counts.withColumn("share", share_of(F.col("n"), F.col("_total"))).drop("_total")
    else:
        counts = counts.withColumn("share", share_of(F.col("n"), counts.agg(F.sum("n")).scalar()))
    return top(counts, n, "n", cols, by, bottom=rare)


def pivot(df: DataFrame, by: list[str], key: str, values: list, aggs: dict[str, str], name: str = "{value}_{agg}") -> DataFrame:
    """Measures x given key values, columns named by a pattern; no extra scan, since the values are given."""
    exprs = [
        F.expr(f"{e} FILTER (WHERE `{key}` = {_sql(v)})").alias(name.format(value=v, agg=a)) for v in values for a, e in aggs.items()
    ]
    return df.groupBy(*by).agg(*exprs)


def _sql(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def seconds_between(a: str, b: str) -> Column:
    """Seconds from a to b with fraction."""
    return F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)) / 1e6


MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def link(
    df: DataFrame, keys: list[str], ts: str, gap_seconds: int, aggs: dict[str, tuple[str, str]] | None = None,
    chunk: str = "hour",
) -> DataFrame:
    """One record per burst of events: start, end, duration, count; a larger gap opens a new record.

    Bursts are found inside (key, ``chunk`` of time) first, so a busy key is
    spread over tasks; then bursts that touch across a chunk edge are joined.
    The second step sees one row per burst, and bursts lie a gap apart, so their
    number per key is limited by the time range.  ``aggs`` maps a name to
    (count | sum | min | max, column).
    """
    aggs = {"n": ("count", "*"), **(aggs or {})}
    part = [*keys, "_chunk"]
    inside = Window.partitionBy(*part).orderBy(ts)
    rows = df.withColumn("_chunk", F.date_trunc(chunk, F.col(ts))).withColumn("_prev", F.lag(ts).over(inside))
    fresh = F.col("_prev").isNull() | (seconds_between("_prev", ts) > gap_seconds)
    rows = rows.withColumn("_part", F.sum(fresh.cast("long")).over(inside))
    pieces = rows.groupBy(*part, "_part").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), *[getattr(F, k)(c).alias(n) for n, (k, c) in aggs.items()]
    )
    across = Window.partitionBy(*keys).orderBy("start")
    pieces = pieces.withColumn("_prev", F.lag("end").over(across))
    apart = F.col("_prev").isNull() | (seconds_between("_prev", "start") > gap_seconds)
    pieces = pieces.withColumn("session", F.sum(apart.cast("long")).over(across))
    out = pieces.groupBy(*keys, "session").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), *[MERGE[k](n).alias(n) for n, (k, _) in aggs.items()]
    )
    return out.withColumn("duration", seconds_between("start", "end"))


def profile(df: DataFrame) -> DataFrame:
    """Per column: count, nulls, distinct, min, max, mean and most common value.

    One pass gives the plain measures; distinct and top value come from counts
    per (column, value), which combine before they are shuffled.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    one = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"), F.count(c).alias("n"), (F.count("*") - F.count(c)).alias("nulls"),
                F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"),
                (F.avg(c) if c in numeric else F.lit(None)).cast("double").alias("mean"),
            ).alias(c)
            for c in df.columns
        ]
    )
    measures = one.select(F.explode(F.array(*df.columns)).alias("m")).select("m.*")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns])
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL")
    counts = counts.groupBy("column", "value").agg(F.count("*").alias("c"))
    common = counts.groupBy("column").agg(
        F.count("*").alias("distinct"), F.min_by("value", F.struct((-F.col("c")).alias("c"), F.col("value"))).alias("top_value")
    )
    return measures.join(common, "column", "left").fillna({"distinct": 0})


def facets(df: DataFrame, facet_cols: list[str], filters: dict[str, object], limit: int) -> DataFrame:
    """Value counts per facet; each facet ignores its own filter.  One scan for all facets."""
    parts = []
    for f in facet_cols:
        others = [to_column(c) for n, c in filters.items() if n != f]
        keep = reduce(lambda a, b: a & b, others, F.lit(True))
        parts.append(F.when(keep, F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))))
    long = df.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).select("p.*")
    counts = long.groupBy("facet", "value").agg(F.count("*").alias("n"))
    return top(counts, limit, "n", ["value"], ["facet"])


def analytics(df: DataFrame, dims: list[str], aggs: dict[str, str], sets: list[list[str]]) -> DataFrame:
    """Aggregates per chosen dimension set; ``level`` names the set, ``total`` for the empty one."""
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *dims)
    marks = [F.grouping(d).alias(f"_g_{d}") for d in dims]
    out = grouped.agg(*[F.expr(e).alias(n) for n, e in aggs.items()], *marks)
    names = F.array_compact(F.array(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dims]))
    level = F.when(F.size(names) == 0, "total").otherwise(F.array_join(names, ","))
    return out.select(level.alias("level"), *dims, *aggs)


def status_counts(df: DataFrame, by: list[str], status: str, values: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values])


def summary_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """min, max, mean, quartiles and standard deviation per group."""
    base = [("min", col, "min"), ("max", col, "max"), ("avg", col, "mean"), ("stddev", col, "stddev")]
    return stats(df, by, base + [("p25", col, "q1"), ("median", col, "median"), ("p75", col, "q3")])


def summarize_events(df: DataFrame, by: list[str], ts: str, span: str, is_error: Column) -> DataFrame:
    """Daily counts first, then per group: events, errors, active buckets and busiest bucket."""
    daily = df.groupBy(*by, time_bucket(ts, span).alias("slot")).agg(
        F.count("*").alias("c"), F.count_if(is_error).alias("e")
    )
    return daily.groupBy(*by).agg(
        F.sum("c").alias("events"), F.sum("e").alias("errors"), F.count("*").alias("active"), F.max("c").alias("busiest")
    )


def activity(df: DataFrame, author: str, ts: str, period: str) -> DataFrame:
    """Count per author and period, share of the period and rank in it."""
    counts = df.groupBy(time_bucket(ts, period).alias("period"), author).agg(F.count("*").alias("n"))
    totals = counts.groupBy("period").agg(F.sum("n").alias("_t"))
    shares = counts.join(totals, "period").withColumn("share", share_of(F.col("n"), F.col("_t"))).drop("_t")
    return rank_by_value(shares, ["period"], "n")
