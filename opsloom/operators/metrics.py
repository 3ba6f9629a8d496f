"""Metric summaries, alarms, baselines, trends and forecasts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.aggs import bucket as value_bucket
from opsloom.operators.aggs import seconds_between, top
from opsloom.operators.joins import in_interval
from opsloom.operators.panes import summarize_steps
from opsloom.plans.joining import null_safe_join, share_of
from opsloom.plans.ordered import counted_chunk, ordered_window, top_per_key
from opsloom.plans.predicates import first_match
from opsloom.plans.quantiles import exact_quantiles
from opsloom.plans.storage import cut_lineage
from opsloom.plans.timing import bucket, fill_gaps, spine


def list_metrics(df: DataFrame, name: str, dims: str, wanted: dict[str, str] | None = None) -> DataFrame:
    """Distinct metric name, dimension and value; ``wanted`` keeps points with these dimension values."""
    for k, v in (wanted or {}).items():
        df = df.where(F.col(dims)[k] == v)
    return df.select(F.col(name).alias("name"), F.explode(dims).alias("dimension", "value")).distinct()


def summarize(
    df: DataFrame, ts: str, value: str, interval: str, stat: str, dims: list[str], fill: bool = False, resolution: str | None = None
) -> DataFrame:
    """One statistic per dimension set and interval: columns dims, bucket, v.

    mean sum count min max pNN; rate is the change of the interval mean per
    second since the interval before; absent lists the intervals without a point.
    ``fill`` adds empty intervals as null.  With a ``resolution`` an interval begins at
    every step of it (see ``panes``); without, one begins where the last one ends.
    """
    if resolution:
        out = summarize_steps(df, ts, value, interval, resolution, [stat], dims).drop("stat")
        return fill_gaps(out, dims, resolution, {}) if fill else out
    rows = df.withColumn("bucket", bucket(ts, interval))
    group = [*dims, "bucket"]
    if stat[0] == "p" and stat[1:].isdigit():
        out = exact_quantiles(rows, group, value, {"v": int(stat[1:]) / 100})
    elif stat == "absent":
        seen = rows.select(*group).distinct()
        return null_safe_join(spine(seen, dims, interval), seen, group, "left_anti").withColumn("v", F.lit(1.0))
    else:
        agg = {"mean": F.avg, "rate": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[stat](value)
        out = rows.groupBy(*group).agg(agg.cast("double").alias("v"))
    if stat == "rate":
        w = Window.partitionBy(*dims).orderBy("bucket")
        out = out.withColumn("v", (F.col("v") - F.lag("v").over(w)) / seconds_between_lag("bucket", w))
    return fill_gaps(out, dims, interval, {}) if fill else out


def summarize_many(
    df: DataFrame, ts: str, value: str, interval: str, stats: list[str], dims: list[str], resolution: str | None = None
) -> DataFrame:
    """Several statistics in long form (dims, bucket, stat, v).

    Everything but the quantiles comes from one pass over the points; with a ``resolution``, everything does.
    """
    if resolution:
        return summarize_steps(df, ts, value, interval, resolution, stats, dims)
    group = [*dims, "bucket"]
    rows = df.withColumn("bucket", bucket(ts, interval))
    plain = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    base = rows.groupBy(*group).agg(*[fn(value).cast("double").alias(n) for n, fn in plain.items()])
    base = cut_lineage(base)
    long = lambda frame, stat, v: frame.select(*group, F.lit(stat).alias("stat"), v.alias("v"))
    cells = [F.struct(F.lit(n).alias("stat"), F.col(n).alias("v")) for n in plain if n in stats]
    parts = []
    if "rate" in stats:
        w = Window.partitionBy(*dims).orderBy("bucket")
        cells.append(F.struct(F.lit("rate").alias("stat"), ((F.col("mean") - F.lag("mean").over(w)) / seconds_between_lag("bucket", w)).alias("v")))
    if cells:
        parts.append(base.select(*group, F.array(*cells).alias("_c")).select(*group, F.inline("_c")))
    if "absent" in stats:
        seen = base.select(*group)
        parts.append(long(null_safe_join(spine(seen, dims, interval), seen, group, "left_anti"), "absent", F.lit(1.0)))
    probs = {s: int(s[1:]) / 100 for s in stats if s[0] == "p" and s[1:].isdigit()}
    if probs:
        wide = exact_quantiles(rows, group, value, probs)
        cells = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("v")) for s in probs])
        parts.append(wide.select(*group, F.inline(cells)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def seconds_between_lag(slot: str, w) -> Column:
    return F.timestamp_diff("SECOND", F.lag(slot).over(w), F.col(slot))


@dataclass(frozen=True)
class AlarmRule:
    """Fires once ``pending`` intervals in a row breach ``op threshold``."""

    interval: str
    stat: str
    op: str
    threshold: float
    pending: int = 1
    dims: list[str] = field(default_factory=list)


def evaluate_alarm(df: DataFrame, ts: str, value: str, rule: AlarmRule) -> DataFrame:
    """State per dimension set and interval: OK, PENDING or FIRING, with the length of the breach so far."""
    series = summarize(df, ts, value, rule.interval, rule.stat, rule.dims)
    return alarm_states(series, rule)


def alarm_states(series: DataFrame, rule: AlarmRule) -> DataFrame:
    v = F.round("v", 9)
    breach = {">": v > rule.threshold, ">=": v >= rule.threshold, "<": v < rule.threshold, "<=": v <= rule.threshold}[rule.op]
    rows = series.withColumn("breach", F.coalesce(breach, F.lit(False)))
    w = Window.partitionBy(*rule.dims).orderBy("bucket")
    same = Window.partitionBy(*rule.dims, "breach").orderBy("bucket")
    rows = rows.withColumn("_run", F.row_number().over(w) - F.row_number().over(same))
    run = F.row_number().over(Window.partitionBy(*rule.dims, "breach", "_run").orderBy("bucket"))
    rows = rows.withColumn("run", F.when(F.col("breach"), run).otherwise(0))
    state = F.when(F.col("run") >= rule.pending, "FIRING").when(F.col("breach"), "PENDING").otherwise("OK")
    return rows.withColumn("state", state).drop("_run")


def alarm_history(states: DataFrame, dims: list[str]) -> DataFrame:
    """Transitions only: old state, new state and the time until the next change (null for the last)."""
    w = Window.partitionBy(*dims).orderBy("bucket")
    moves = states.withColumn("from_state", F.lag("state").over(w)).where(~F.col("state").eqNullSafe(F.col("from_state")))
    after = F.lead("bucket").over(w)
    return moves.select(
        *dims, "bucket", "from_state", F.col("state").alias("to_state"),
        F.timestamp_diff("SECOND", F.col("bucket"), after).alias("seconds"),
    )


def dimension_states(states: DataFrame, dims: list[str]) -> DataFrame:
    """Latest state per dimension set."""
    return states.groupBy(*dims).agg(F.max_by("state", "bucket").alias("state"), F.max("bucket").alias("since"))


def suppress(states: DataFrame, windows: DataFrame, slot: str = "bucket", by: list[str] | None = None) -> DataFrame:
    """Drop states inside a suppression window (start, end) of the alarm or, with ``by``, of the dimension."""
    return in_interval(states, windows, slot, "start", "end", 86400, by=by, how="left_anti")


def recurring_windows(windows: DataFrame, until: str) -> DataFrame:
    """Windows with ``repeat_days`` expanded up to a date; null means one-off."""
    step = F.make_dt_interval(F.col("repeat_days"))
    last = F.lit(until).cast("timestamp_ntz")
    starts = F.when(F.col("repeat_days").isNull(), F.array("start")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.floor(F.timestamp_diff("DAY", F.col("start"), last) / F.col("repeat_days")).cast("int")),
            lambda i: F.col("start") + F.make_dt_interval(i * F.col("repeat_days")),
        )
    )
    length = F.col("end") - F.col("start")
    return windows.withColumn("_len", length).withColumn("start", F.explode(starts)).withColumn(
        "end", F.col("start") + F.col("_len")
    ).drop("_len", "repeat_days")


def season_slot(ts: str) -> Column:
    """Hour of the week, Monday 00:00 = 0."""
    return F.weekday(ts) * 24 + F.hour(ts)


def baseline(df: DataFrame, by: list[str], ts: str, value: str, band: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """Expected value and band per group and hour of week."""
    rows = df.withColumn("slot", season_slot(ts))
    return exact_quantiles(rows, [*by, "slot"], value, {"low": band[0], "expected": 0.5, "high": band[1]})


def baseline_points(df: DataFrame, base: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """Points outside the band of their slot."""
    rows = null_safe_join(df.withColumn("slot", season_slot(ts)), cut_lineage(base), [*by, "slot"])
    side = F.when(F.col(value) > F.col("high"), "above").when(F.col(value) < F.col("low"), "below")
    return rows.withColumn("side", side).where(F.col("side").isNotNull())


def usage_trend(df: DataFrame, by: list[str], ts: str, span: str, usage: str, capacity: str) -> DataFrame:
    """Usage, capacity and percent per period, with the slope of usage per period over the whole key."""
    series = df.groupBy(*by, bucket(ts, span).alias("period")).agg(
        F.expr(usage).alias("usage"), F.expr(capacity).alias("capacity")
    )
    series = cut_lineage(series)
    origin = series.agg(F.min("period")).scalar()
    slopes = series.withColumn("_x", F.timestamp_diff("DAY", origin, F.col("period")).cast("double"))
    slopes = slopes.groupBy(*by).agg(F.regr_slope("usage", "_x").alias("slope_per_day"))
    out = null_safe_join(series, slopes, by)
    return out.withColumn("percent", F.try_divide(F.col("usage") * 100, F.col("capacity")))


def forecast(df: DataFrame, by: list[str], ts: str, span_days: int, measure: str, horizon: int, k: float = 2.0) -> DataFrame:
    """Linear fit over buckets of whole days, with future rows and a residual band of k standard errors.

    x counts buckets since 1970, so the first day need not be looked up.
    """
    x = F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-01")) / span_days)
    series = df.groupBy(*by, x.alias("x")).agg(F.expr(measure).alias("y"))
    return forecast_series(series, by, horizon, k)


def forecast_series(series: DataFrame, by: list[str], horizon: int, k: float = 2.0) -> DataFrame:
    """The same on a ready series (by, x, y) with integer x."""
    x = F.col("x").cast("double")
    fit = series.groupBy(*by).agg(
        F.regr_slope("y", x).alias("slope"), F.regr_intercept("y", x).alias("intercept"), F.regr_r2("y", x).alias("r2"),
        F.sqrt(F.try_divide(F.greatest(F.regr_syy("y", x) - F.regr_slope("y", x) * F.regr_sxy("y", x), F.lit(0.0)), F.count("*") - 2)).alias("err"),
        F.max("x").alias("_last"),
    )
    ahead = fit.withColumn("x", F.explode(F.sequence(F.col("_last") + 1, F.col("_last") + horizon)))
    value = F.col("intercept") + F.col("slope") * F.col("x")
    return ahead.select(
        *by, "x", value.alias("forecast"), (value - k * F.col("err")).alias("low"), (value + k * F.col("err")).alias("high"), "slope", "r2"
    )


def seasonal_forecast(series: DataFrame, by: list[str], season: int, horizon: int) -> DataFrame:
    """Linear trend plus mean seasonal offset per group of an aggregated series (by, x, y) with integer x.

    A group of one point, or of one x, has no trend; a place of the season without a point has no offset.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    series = cut_lineage(series.select(*by, F.col("x").cast("bigint").alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL"))
    fit = series.groupBy(*by).agg(F.coalesce(F.regr_slope("y", x), F.lit(0.0)).alias("_slope"), F.avg("y").alias("_y"), F.avg(x).alias("_x"), F.max("x").alias("_last"))
    fit = cut_lineage(fit.select(*by, "_slope", (F.col("_y") - F.col("_slope") * F.col("_x")).alias("_level"), "_last"))
    line = F.col("_level") + F.col("_slope") * x
    slot = F.pmod("x", F.lit(season)).alias("_slot")
    offsets = null_safe_join(series, fit, by).groupBy(*by, slot).agg(F.avg(F.col("y") - line).alias("_offset"))
    ahead = fit.withColumn("x", F.explode(F.sequence(F.col("_last") + 1, F.col("_last") + horizon)))
    ahead = ahead.select(*by, "x", slot, line.alias("_line"))
    out = null_safe_join(ahead, offsets, [*by, "_slot"], "left")
    return out.select(*by, "x", (F.col("_line") + F.coalesce("_offset", F.lit(0.0))).alias("forecast"))


def top_usage(df: DataFrame, ts: str, span: str, key: str, measure: str, n: int) -> DataFrame:
    """Largest keys per time bucket."""
    sums = df.groupBy(bucket(ts, span).alias("bucket"), key).agg(F.expr(measure).alias("v"))
    return top_per_key(sums, ["bucket"], [F.col("v").desc(), F.col(key)], n)


def sql_insights(series: DataFrame, key: str, x: str, y: str, limits: dict[str, float]) -> DataFrame:
    """Flags per statement key: degrading (slope), variant (stddev / mean), inefficient (mean)."""
    out = series.groupBy(key).agg(
        F.regr_slope(y, F.col(x).cast("double")).alias("slope"), F.avg(y).alias("mean"),
        F.try_divide(F.stddev_samp(y), F.avg(y)).alias("variation"),
    )
    return out.withColumns(
        {
            "degrading": F.coalesce(F.col("slope") > limits["slope"], F.lit(False)),
            "variant": F.coalesce(F.col("variation") > limits["variation"], F.lit(False)),
            "inefficient": F.coalesce(F.col("mean") > limits["mean"], F.lit(False)),
        }
    )


def distribution(df: DataFrame, col: str, edges: list[float], by: list[str]) -> DataFrame:
    """Count, share and cumulative share per value band; band i is [edges[i-1], edges[i])."""
    band = F.lit(0)
    for e in edges:
        band = band + (F.col(col) >= e).cast("int")
    counts = df.groupBy(*by, band.alias("band")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(whole)
    return counts.withColumns(
        {"share": share_of(F.col("n"), total), "cumulative": share_of(F.sum("n").over(upto), total)}
    )


def counter_rate(df: DataFrame, by: list[str], ts: str, counter: str, order: list[str], chunk: Column | None = None) -> DataFrame:
    """Snapshots of a growing counter to increments and rates; a fall is a reset, counted from zero.

    Without a ``chunk`` one is chosen by counts.
    """
    chunk = chunk if chunk is not None else counted_chunk(df, by, ts)
    rows = ordered_window(df, by, order, chunk, lag={"_pts": ts, "_pc": counter})
    grown = F.col(counter) - F.col("_pc")
    increment = F.when(grown < 0, F.col(counter)).otherwise(grown)
    return rows.withColumns(
        {"increment": increment, "is_reset": F.coalesce(grown < 0, F.lit(False)), "rate": F.try_divide(increment, seconds_between("_pts", ts))}
    ).drop("_pts", "_pc")


def top_waits(df: DataFrame, event: str, wait: str, bands: list[tuple[str, float | None, float | None]], n: int) -> DataFrame:
    """Wait events by total time, with the number of waits per band of length."""
    rows = value_bucket(df, wait, "_band", ranges=bands)
    cols = [F.count_if(F.col("_band") == name).alias(f"n_{name}") for name, _, _ in bands]
    sums = rows.groupBy(event).agg(F.sum(wait).alias("total"), F.count("*").alias("waits"), *cols)
    return top(sums, n, "total", [event])


def changes(df: DataFrame, by: list[str], value: str, order: list[str], chunk: Column) -> DataFrame:
    """Rows whose value differs from the one before, with the old value; the first row is no change."""
    rows = ordered_window(df.withColumn("_has", F.lit(1)), by, order, chunk, lag={"_had": "_has", "old_value": value})
    moved = F.col("_had").isNotNull() & ~F.col(value).eqNullSafe(F.col("old_value"))
    return rows.where(moved).drop("_has", "_had")


def rightsize(df: DataFrame, by: list[str], value: str, p: float, low: float, high: float) -> DataFrame:
    """Under or over used by a percentile of utilisation."""
    out = exact_quantiles(df, by, value, {"usage": p})
    advice = first_match([(F.col("usage") < low, "DOWNSIZE"), (F.col("usage") > high, "UPSIZE")], "KEEP")
    return out.withColumn("advice", advice)
