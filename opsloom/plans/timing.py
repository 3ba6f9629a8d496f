"""Time buckets and gap-free series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.plans.joining import null_safe_join
from opsloom.plans.storage import cut_lineage

UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds_of(ts: str | Column) -> Column:
    """Whole seconds of a wall-clock time since 1970; the session's zone plays no part for a time without zone."""
    col = F.col(ts) if isinstance(ts, str) else ts
    day = F.datediff(col.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return day * 86400 + F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)


def length_of(span: str) -> int:
    """Seconds of a length such as ``15 minutes``."""
    amount, _, unit = span.strip().partition(" ")
    return int(amount) * SECONDS[unit.strip().lower().rstrip("s")]


def bucket(ts: str | Column, span: str) -> Column:
    """Start of the bucket: a calendar unit (``day``) or a length (``15 minutes``), as timestamp without zone.

    Works on the wall-clock parts, so no hour is skipped or repeated by the session's zone; a
    null time has a null bucket for every span.
    """
    col = F.col(ts) if isinstance(ts, str) else ts
    if span in ("day", "week", "month", "quarter", "year"):
        return F.trunc(col.cast("date"), span).cast("timestamp_ntz") if span != "day" else col.cast("date").cast("timestamp_ntz")
    size = SECONDS[span] if span in UNITS else length_of(span)
    start = F.floor(seconds_of(col) / size) * size
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.floor(start / 86400).cast("int"), F.lit(0), F.lit(0), F.pmod(start, F.lit(86400)).cast("decimal(18,6)"))


def step_of(span: str) -> Column:
    amount = "3 month" if span == "quarter" else f"1 {span}" if span in UNITS else span
    return F.expr(f"INTERVAL {amount}")


def spine(series: DataFrame, by: list[str], span: str, slot: str = "bucket") -> DataFrame:
    """Every (group, bucket) between the first and last bucket of the whole series.

    ``series`` is already aggregated; its bounds enter as scalar subqueries.
    """
    first = series.agg(F.min(slot)).scalar()
    last = series.agg(F.max(slot)).scalar()
    keys = series.select(*by).distinct() if by else series.agg(F.count("*").alias("_n")).drop("_n")
    full = keys.withColumn(slot, F.explode(F.sequence(first, last, step_of(span))))
    return full.withColumn(slot, F.col(slot).cast("timestamp_ntz"))


def fill_gaps(
    series: DataFrame, by: list[str], span: str, fill: dict | None = None, slot: str = "bucket", written: bool = False
) -> DataFrame:
    """Add the empty buckets; ``fill`` gives the value of named columns there, others stay null.

    The series is needed for its bounds, its groups and its rows, so it is
    written out first (unless ``written`` says it is): the raw data are read once.
    """
    series = series if written else cut_lineage(series)
    full = null_safe_join(spine(series, by, span, slot), series, [*by, slot], "left")
    return full.fillna(fill) if fill else full
