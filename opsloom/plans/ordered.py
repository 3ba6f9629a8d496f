"""Ordered windows that stay distributed when one key holds a large share of the rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a whole key into one task.
Here the key is cut into chunks of the order (an hour, a block of ids).  Each
chunk is a window partition of its own; what it must know about the rows before
it (last row, running totals, row count) or after it (first row) is computed
from a table with one row per key and chunk, and enters the chunk as one virtual
head or tail row.  The result equals the plain window, with one shuffle of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.plans.joining import null_safe_join
from opsloom.plans.storage import cut_lineage

_HEAD, _ROW, _TAIL = 0, 1, 2


def time_chunk(ts: str, unit: str = "hour") -> Column:
    return F.date_trunc(unit, F.col(ts))


def step_chunk(col: str, step: int) -> Column:
    return F.floor(F.col(col) / F.lit(step))


def counted_chunk(df: DataFrame, by: list[str], ts: str, rows: int = 1_000_000) -> Column:
    """The longest of day, hour, minute and second in which no key has more than ``rows`` rows (a second if all have).

    One scan counts per key and minute; the longer units are added up from that table.
    """
    minutes = cut_lineage(df.groupBy(*by, time_chunk(ts, "minute").alias("_at")).agg(F.count("*").alias("_n")))
    for unit in ("day", "hour", "minute"):
        largest = minutes.groupBy(*by, time_chunk("_at", unit)).agg(F.sum("_n").alias("_n")).agg(F.max("_n")).first()[0] or 0
        if largest <= rows:
            return time_chunk(ts, unit)
    return time_chunk(ts, "second")


def _summary(kind: str, name: str, order: Column) -> Column:
    col = F.col(name)
    if kind in ("sum", "count"):
        return F.sum(col)
    if kind == "last":
        return F.max_by(col, F.when(col.isNotNull(), order))
    return {"max": F.max, "min": F.min}[kind](col)


def _over(kind: str, name: str, window) -> Column:
    if kind == "last":
        return F.last(name, ignorenulls=True).over(window)
    return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[kind](name).over(window)


def ordered_window(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    running: dict[str, tuple[str, Column]] | None = None,
    number: str | None = None,
    exclusive: tuple[str, ...] = (),
) -> DataFrame:
    """Add previous-row, next-row, running and row-number columns per key.

    ``order`` are column names, ascending, and must be unique within a key.
    ``chunk`` must grow with the order.  ``running`` maps an output name to
    (kind, expression), kind one of sum, count, max, min, last (last non-null);
    the frame is from the first row of the key to the current one, or to the row
    before it for names in ``exclusive``.
    """
    lag, lead, running = lag or {}, lead or {}, dict(running or {})
    if number:
        running[number] = ("sum", F.lit(1).cast("long"))
    exclusive = set(exclusive)
    part = [*keys, "_chunk"]
    work = {"_chunk": chunk, "_kind": F.lit(_ROW)}
    if lag:
        work["_prev"] = F.struct(*[F.col(c).alias(o) for o, c in lag.items()])
    if lead:
        work["_next"] = F.struct(*[F.col(c).alias(o) for o, c in lead.items()])
    for i, (kind, expr) in enumerate(running.values()):
        work[f"_run{i}"] = F.when(expr.isNotNull(), F.lit(1).cast("long")).otherwise(0) if kind == "count" else expr
    rows = df.withColumns(work)

    position = F.struct(*order)
    totals = []
    if lag:
        totals.append(F.max_by("_prev", position).alias("_prev"))
    if lead:
        totals.append(F.min_by("_next", position).alias("_next"))
    for i, (kind, _) in enumerate(running.values()):
        totals.append(_summary(kind, f"_run{i}", position).alias(f"_run{i}"))
    summary = rows.groupBy(*part).agg(*totals)

    across = Window.partitionBy(*keys).orderBy("_chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    head = [*part, F.lit(_HEAD).alias("_kind")]
    if lag:
        head.append(F.lag("_prev").over(across).alias("_prev"))
    for i, (kind, _) in enumerate(running.values()):
        head.append(_over(kind, f"_run{i}", before).alias(f"_run{i}"))
    everything = rows
    if lag or running:
        everything = everything.unionByName(summary.select(*head), allowMissingColumns=True)
    if lead:
        tail = [*part, F.lit(_TAIL).alias("_kind"), F.lead("_next").over(across).alias("_next")]
        everything = everything.unionByName(summary.select(*tail), allowMissingColumns=True)

    inside = Window.partitionBy(*part).orderBy("_kind", *order)
    out = {}
    if lag:
        out["_before"] = F.lag("_prev").over(inside)
    if lead:
        out["_after"] = F.lead("_next").over(inside)
    for i, (name, (kind, _)) in enumerate(running.items()):
        frame = inside.rowsBetween(Window.unboundedPreceding, -1 if name in exclusive else Window.currentRow)
        out[f"_out{i}"] = _over(kind, f"_run{i}", frame)
    done = everything.withColumns(out).where(F.col("_kind") == _ROW)
    result = [F.col(c) for c in df.columns]
    result += [F.col(f"_before.{o}").alias(o) for o in lag]
    result += [F.col(f"_after.{o}").alias(o) for o in lead]
    result += [F.col(f"_out{i}").alias(name) for i, name in enumerate(running)]
    return done.select(*result)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key.  Spark limits each map task to n rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def rank_by_value(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """``rank()`` of a measure within each key, largest first, without sorting a whole key.

    Rows are counted per distinct value; only that histogram is ordered.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_here"))
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(out, F.coalesce(F.sum("_here").over(w), F.lit(0)) + 1).drop("_here")
    return null_safe_join(df, ranks, [*keys, value])
