"""Sort, head and tail, set operations, deltas, sequences and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.aggs import seconds_between
from opsloom.operators.columns import matching_columns
from opsloom.plans.ordered import counted_chunk, ordered_window, time_chunk
from opsloom.plans.storage import cut_lineage
from opsloom.plans.timing import bucket, fill_gaps


def sort(df: DataFrame, rules: list[tuple[str, str, str]], pattern: bool = False) -> DataFrame:
    """Rules are (column or name pattern, asc|desc, first|last for nulls)."""
    keys = []
    for name, way, nulls in rules:
        for c in matching_columns(df, pattern=name) if pattern else [name]:
            keys.append(getattr(F.col(c), f"{way}_nulls_{nulls}")())
    return df.orderBy(*keys)


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc_nulls_first() for c in order]).limit(n)


def union(dfs: list[DataFrame], by: str = "name", all: bool = True) -> DataFrame:
    add = (lambda a, b: a.unionByName(b)) if by == "name" else (lambda a, b: a.union(b))
    out = reduce(add, dfs)
    return out if all else out.distinct()


def intersect(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    return a.intersectAll(b) if all else a.intersect(b)


def minus(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    return a.exceptAll(b) if all else a.subtract(b)


def delta(df: DataFrame, cols: list[str], by: list[str], ts: str, order: list[str], chunk: Column | None = None) -> DataFrame:
    """Difference to the previous row of the key and change per second; without a ``chunk`` one is chosen by counts."""
    chunk = chunk if chunk is not None else counted_chunk(df, by, ts)
    rows = ordered_window(df, by, order, chunk, lag={"_pts": ts, **{f"_p_{c}": c for c in cols}})
    for c in cols:
        diff = F.col(c) - F.col(f"_p_{c}")
        rows = rows.withColumn(f"{c}_delta", diff)
        rows = rows.withColumn(f"{c}_rate", F.try_divide(diff, seconds_between("_pts", ts)))
    return rows.drop("_pts", *[f"_p_{c}" for c in cols])


def sequence(
    df: DataFrame, by: list[str], ts: str, steps: list[Column], within_seconds: int, order: list[str],
    chunk: Column | None = None,
) -> DataFrame:
    """Ends of chains step 1 < step 2 < ... of one key within a time limit, each with its latest start.

    Only rows of some step take part.  One running maximum per step carries the
    latest possible start forward; the rows are written out between two steps,
    so that a step does not repeat the ones before it.
    """
    chunk = chunk if chunk is not None else time_chunk(ts)
    rows = df.where(reduce(lambda a, b: a | b, steps)).withColumn("_start", F.when(steps[0], F.col(ts)))
    for i, step in enumerate(steps[1:], start=1):
        carried = ordered_window(rows, by, order, chunk, running={"_best": ("max", F.col("_start"))}, exclusive=("_best",))
        rows = carried.withColumn("_start", F.when(step, F.col("_best"))).drop("_best")
        if i < len(steps) - 1:
            rows = cut_lineage(rows)
    hit = F.col("_start").isNotNull() & (seconds_between("_start", ts) <= within_seconds)
    return rows.where(hit).withColumnRenamed("_start", "chain_start")


def trend(df: DataFrame, by: list[str], ts: str, span: str, measure: str) -> DataFrame:
    """Per key the bucket values in time order and the slope per bucket; empty buckets count 0."""
    series = df.groupBy(*by, bucket(ts, span).alias("bucket")).agg(F.expr(measure).cast("double").alias("v"))
    series = cut_lineage(series)
    full = fill_gaps(series, by, span, {"v": 0.0}, written=True)
    first = series.agg(F.min("bucket")).scalar()
    x = F.timestamp_diff("SECOND", first, F.col("bucket"))
    points = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "v"))), lambda p: p["v"])
    return full.withColumn("_x", x.cast("double")).groupBy(*by).agg(points.alias("points"), F.regr_slope("v", "_x").alias("slope"))


def timecluster(df: DataFrame, key: str, ts: str, span: str, measure: str) -> DataFrame:
    """Keys whose bucket series has the same shape (the signs of its steps), with size and first member."""
    series = df.groupBy(key, bucket(ts, span).alias("bucket")).agg(F.expr(measure).cast("double").alias("v"))
    full = fill_gaps(series, [key], span, {"v": 0.0})
    step = F.col("v") - F.lag("v").over(Window.partitionBy(key).orderBy("bucket"))
    sign = F.when(step > 0, "+").when(step < 0, "-").when(step == 0, "=").otherwise("")
    marks = full.withColumn("_s", sign).groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "_s"))), lambda p: p["_s"]), "").alias("shape")
    )
    return marks.groupBy("shape").agg(F.count("*").alias("members"), F.min(key).alias("example"))
