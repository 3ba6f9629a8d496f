"""Summaries of overlapping intervals from panes.

An interval that begins at every step of a finer resolution holds whole panes, the stretches of
one step.  Points are reduced to one partial result per pane, in one read; each pane then enters the
intervals that hold it, where partials are merged.  The mergeable form of a quantile is the
histogram of a pane's values, so quantiles are as exact as sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.plans.joining import null_safe_join
from opsloom.plans.quantiles import exact_quantiles
from opsloom.plans.storage import cut_lineage
from opsloom.plans.timing import SECONDS, UNITS, bucket, length_of, spine

PLAIN = ("mean", "sum", "count", "min", "max")


def seconds_in(span: str) -> int:
    """Seconds of a fixed length: ``hour``, ``15 minutes``; a month or year has none."""
    unit = span in UNITS
    if unit and span not in SECONDS:
        raise ValueError(f"{span} has no fixed length")
    return SECONDS[span] if unit else length_of(span)


def _starts(pane: str, steps: int, seconds: int) -> Column:
    """The starts of the intervals that hold a pane."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.col(pane) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (i * seconds).cast("decimal(18,6)")))


def summarize_steps(df: DataFrame, ts: str, value: str, interval: str, resolution: str, stats: list[str], dims: list[str]) -> DataFrame:
    """Statistics (dims, bucket, stat, v) of the intervals [bucket, bucket + interval) that begin at each step of ``resolution``.

    mean sum count min max pNN, of the intervals with a point; rate is the change of the mean per
    second since the interval one row before; absent lists the steps between the first and
    last interval whose interval has no point.  ``interval`` must be a multiple of
    ``resolution``.  A null value is a point without a number: it counts for absent only; a null time is in no interval.
    """
    step, whole = seconds_in(resolution), seconds_in(interval)
    if whole % step:
        raise ValueError("the interval must be a multiple of the resolution")
    probs = {s: int(s[1:]) / 100 for s in stats if s[0] == "p" and s[1:].isdigit()}
    unknown = {*stats} - {*PLAIN, "rate", "absent"} - probs.keys()
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    group = [*dims, "bucket"]
    points = df.where(F.col(ts).isNotNull()).select(*dims, bucket(ts, resolution).alias("_pane"), F.col(value).alias("_v"))
    v = F.col("_v").cast("double")
    if probs:
        # the histogram is the only thing read from the points; the other partials come from it
        counts = cut_lineage(points.groupBy(*dims, "_pane", "_v").agg(F.count("*").alias("_c")))
        partial = counts.groupBy(*dims, "_pane").agg(F.sum(v * F.col("_c")).alias("sum"), F.sum(F.when(v.isNotNull(), F.col("_c")).otherwise(0)).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"))
    else:
        partial = points.groupBy(*dims, "_pane").agg(F.sum(v).alias("sum"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"))
    spread = lambda panes: panes.withColumn("bucket", F.explode(_starts("_pane", whole // step, step)))
    merged = spread(partial).groupBy(*group).agg(*(fn(name).alias(name) for name, fn in (("sum", F.sum), ("count", F.sum), ("min", F.min), ("max", F.max))))
    series = cut_lineage(merged.withColumn("mean", F.try_divide(F.col("sum"), F.col("count").cast("double"))))
    cells = [F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for s in PLAIN if s in stats]
    if "rate" in stats:
        w = Window.partitionBy(*dims).orderBy("bucket")
        apart = F.timestamp_diff("SECOND", F.lag("bucket").over(w), F.col("bucket"))
        series_rate = series.withColumn("rate", (F.col("mean") - F.lag("mean").over(w)) / apart)
        cells.append(F.struct(F.lit("rate").alias("stat"), F.col("rate").alias("v")))
    else:
        series_rate = series
    parts = [series_rate.select(*group, F.array(*cells).alias("_cells")).select(*group, F.inline("_cells"))] if cells else []
    if "absent" in stats:
        seen = series.select(*group)
        empty = null_safe_join(spine(seen, dims, resolution), seen, group, "left_anti")
        parts.append(empty.select(*group, F.lit("absent").alias("stat"), F.lit(1.0).alias("v")))
    if probs:
        wide = exact_quantiles(spread(counts), group, "_v", probs, weight="_c")
        named = F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("v")) for s in probs))
        parts.append(wide.select(*group, F.inline(named)))
    return reduce(lambda a, b: a.unionByName(b), parts)
