"""Joins, lookups, key checks and comparisons; lookups by pattern are in ``matching``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.plans.joining import salted_join
from opsloom.plans.ordered import ordered_window, top_per_key
from opsloom.plans.storage import cut_lineage
from opsloom.plans.timing import seconds_of


def join(left: DataFrame, right: DataFrame, on, how: str = "inner", salts: int = 0) -> DataFrame:
    """Join on column names or a condition; the physical join is Spark's choice.

    ``salts`` spreads hot keys of the left side; without it adaptive execution
    splits the partitions it measures as skewed.
    """
    if salts and isinstance(on, list) and all(isinstance(c, str) for c in on):
        return salted_join(left, right, on, how, salts)
    return left.join(right, on, how)


def lookup(
    df: DataFrame, ref: DataFrame, on: list[str], cols: list[str], multi: str = "first",
    order: list[str] | None = None, default: dict | None = None,
) -> DataFrame:
    """Add reference columns; never multiplies rows unless ``multi="all"``.

    first / last pick one reference row per key by ``order``; error fails when a
    key that is looked up has more than one row.
    """
    fields = F.struct(*cols)
    if multi in ("first", "last"):
        pick = F.min_by if multi == "first" else F.max_by
        one = ref.groupBy(*on).agg(pick(fields, F.struct(*(order or cols))).alias("_hit"))
    elif multi == "error":
        many = F.raise_error(F.lit("lookup key is not unique"))
        one = ref.groupBy(*on).agg(F.when(F.count("*") > 1, many.cast("string")).alias("_e"), F.first(fields).alias("_hit"))
        one = one.select(*on, F.when(F.col("_e").isNull(), F.col("_hit")).alias("_hit"))
    elif multi == "all":
        one = ref.select(*on, fields.alias("_hit"))
    else:
        raise ValueError(f"unknown mode {multi!r}")
    default = default or {}
    out = [F.coalesce(F.col(f"_hit.{c}"), F.lit(default[c])).alias(c) if c in default else F.col(f"_hit.{c}").alias(c) for c in cols]
    return df.join(one, on, "left").select(*df.columns, *out)


def map_rows(df: DataFrame, other: DataFrame, on: list[str], aggs: dict[str, str]) -> DataFrame:
    """Fields of a second result, aggregated per key first, added to the rows that match."""
    small = other.groupBy(*on).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
    return df.join(small, on, "left")


def orphans(child: DataFrame, parent: DataFrame, fk: list[str], pk: list[str]) -> DataFrame:
    """Child rows whose foreign key has no parent; a null in the key is not a violation."""
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(pk)]).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(f) == F.col(f"_p{i}") for i, f in enumerate(fk)])
    return child.dropna(subset=fk).join(keys, cond, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def compare_periods(
    df: DataFrame, ts: str, keys: list[str], aggs: dict[str, str], start: str, end: str, shift: str
) -> DataFrame:
    """Now, then, difference and percent change per key; ``then`` is the same range moved back by ``shift``.

    Both periods are filtered aggregates of one scan.
    """
    lit = lambda x: f"TIMESTAMP_NTZ '{x}'"
    now = f"{ts} >= {lit(start)} AND {ts} < {lit(end)}"
    then = f"{ts} >= {lit(start)} - INTERVAL {shift} AND {ts} < {lit(end)} - INTERVAL {shift}"
    cols = []
    for name, expr in aggs.items():
        cols.append(F.expr(f"{expr} FILTER (WHERE {now})").alias(f"{name}_now"))
        cols.append(F.expr(f"{expr} FILTER (WHERE {then})").alias(f"{name}_then"))
    out = df.where(f"({now}) OR ({then})").groupBy(*keys).agg(*cols)
    for name in aggs:
        diff = F.col(f"{name}_now") - F.col(f"{name}_then")
        out = out.withColumn(f"{name}_diff", diff)
        out = out.withColumn(f"{name}_pct", F.try_divide(diff * 100.0, F.col(f"{name}_then")))
    return out


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ: status only_left, only_right or changed, with the changed column names."""
    values = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*values).alias("_a"))
    right = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*values).alias("_b"))
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    both = left.join(right, cond, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in values]))
    status = (
        F.when(F.col("_b").isNull(), "only_left")
        .when(F.col("_a").isNull(), "only_right")
        .when(F.size(changed) > 0, "changed")
    )
    names = F.when(status == "changed", F.array_join(F.array_sort(changed), ","))
    out = [F.when(F.col("_a").isNotNull(), F.col(k)).otherwise(F.col(f"_k_{k}")).alias(k) for k in keys]
    return both.select(*out, status.alias("status"), names.alias("changed_columns")).where(F.col("status").isNotNull())


def in_interval(
    events: DataFrame, intervals: DataFrame, ts: str, start: str, end: str, bucket_seconds: int = 86400,
    by: list[str] | None = None, how: str = "inner", salts: int = 1, key: list[str] | None = None,
    per: list[str] | None = None, count: str = "n", totals: dict[str, str] | None = None,
) -> DataFrame:
    """Events inside [start, end) of an interval, optionally of the same ``by`` key.

    Both sides get a time bucket as equi key, the exact bounds are checked after
    it.  ``salts`` spreads a bucket that holds very many events.  For left_semi
    and left_anti an event counts once.

    With ``per`` (columns of the intervals) the result is the inner join summed up per value of
    these, without forming its pairs: ``per``, the number of pairs as ``count``, and for each name
    in ``totals`` the sum of that event column; see ``_interval_totals``.
    """
    by = by or []
    if per is not None:
        if how != "inner":
            raise ValueError(f"totals of an interval join cannot be {how}")
        pairs = lambda some: in_interval(some, intervals, ts, start, end, bucket_seconds, by, "inner", salts, key)
        return _interval_totals(events, intervals, ts, start, end, bucket_seconds, by, per, count, totals or {}, pairs)
    slot = lambda c: F.floor(seconds_of(c) / bucket_seconds)
    last = slot(end)
    spread = intervals.where(F.col(start) < F.col(end)).withColumn("_slot", F.explode(F.sequence(slot(start), last)))
    left = events.withColumn("_slot", slot(ts))
    on = [*by, "_slot"]
    if salts > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in (key or [ts])]), F.lit(salts)).cast("int"))
        spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append("_salt")
    a, b = left.alias("e"), spread.alias("i")
    cond = reduce(lambda x, y: x & y, [F.col(f"e.{c}") == F.col(f"i.{c}") for c in on])
    cond = cond & (F.col(f"e.{ts}") >= F.col(f"i.{start}")) & (F.col(f"e.{ts}") < F.col(f"i.{end}"))
    hit = a.join(b, cond, how)
    if how in ("left_semi", "left_anti"):
        return hit.drop(*[c for c in ("_slot", "_salt") if c in left.columns])
    extra = [F.col(f"i.{c}") for c in intervals.columns if c not in by]
    return hit.select(*[F.col(f"e.{c}") for c in events.columns], *extra)


#: Real numbers of this size and beyond, and those that are not finite, have no decimal that leaves room for sums.
_LARGEST = 1e20


def _interval_totals(
    events: DataFrame, intervals: DataFrame, ts: str, start: str, end: str, bucket_seconds: int, by: list[str], per: list[str],
    count: str, totals: dict[str, str], pairs, rows: int = 1_000_000,
) -> DataFrame:
    """Count and sums of the events of each interval, added up per ``per``; values without an event are left out.

    Events and bounds are brought into one order of time.  What an interval holds is what came
    before its end less what came before its start, so the work grows with events plus intervals
    and not with what meets.  Real numbers are summed as decimals of 20 digits, counted from the
    largest one, which leaves 18 for sums, so that the difference is exact; events with a number
    that no such decimal holds are met in pairs.  A sum of nulls alone is null.
    """
    kinds = {c: events.schema[c].dataType for c in set(totals.values())}
    reals = {c: kind for c, kind in kinds.items() if isinstance(kind, (T.DoubleType, T.FloatType))}
    plain = reduce(lambda a, b: a & b, [F.col(c).isNull() | (F.abs(F.col(c)) < _LARGEST) for c in reals], F.lit(True))
    value = {c: F.col(c) for c in kinds}
    odd = 0
    if reals:
        # one scan for the size of the numbers, which sets the digits after the point
        largest = events.agg(F.count_if(~plain), *[F.max(F.when(plain, F.abs(F.col(c)))) for c in reals]).first()
        odd = largest[0]
        for c, top in zip(reals, largest[1:]):
            value[c] = F.col(c).cast("double").cast(f"decimal(38,{20 - len(str(int(top or 0)))})")
    keys = [f"_by{i}" for i in range(len(by))]
    group = [F.col(c).alias(k) for c, k in zip(by, keys)]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.lit(True))
    names = [f"_per{i}" for i in range(len(per))]
    took = [F.col(c).alias(n) for c, n in zip(per, names)]
    happened = events.where(plain & known & F.col(ts).isNotNull()).select(
        *group, F.col(ts).alias("_at"), F.lit(1).alias("_side"), F.lit(1).cast("bigint").alias("_n"), *[v.alias(f"_v{i}") for i, v in enumerate(value.values())]
    )
    # at equal times bounds come first: an event at the start is inside, one at the end is not
    bound = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(True).alias("opens")), F.struct(F.col(end).alias("at"), F.lit(False).alias("opens"))))
    bounds = intervals.where((F.col(start) < F.col(end)) & known).select(*group, *took, bound.alias("_b"))
    bounds = bounds.select(*keys, *names, F.col("_b.at").alias("_at"), F.lit(0).alias("_side"), F.col("_b.opens").alias("_opens"))
    points = happened.unionByName(bounds, allowMissingColumns=True)
    zoned = isinstance(points.schema["_at"].dataType, T.TimestampType)
    second = F.unix_seconds("_at") if zoned else seconds_of("_at")
    # chunks of the bucket's length, or shorter ones where one would be too much for a task
    width = bucket_seconds
    if width > 60:
        minutes = cut_lineage(points.groupBy(*keys, F.floor(second / 60).alias("_m")).agg(F.count("*").alias("_rows")))
        most = lambda size: minutes.groupBy(*keys, F.floor(F.col("_m") * 60 / size)).agg(F.sum("_rows").alias("_rows")).agg(F.max("_rows")).first()[0] or 0
        width = next((size for size in (bucket_seconds, 60) if most(size) <= rows), 1)
    running = {"_n_": ("sum", F.col("_n"))}
    for i in range(len(value)):
        running |= {f"_c{i}_": ("count", F.col(f"_v{i}")), f"_v{i}_": ("sum", F.col(f"_v{i}"))}
    passed = ordered_window(points, keys, ["_at", "_side"], F.floor(second / width), running=running).where("_side = 0")
    less = lambda c: F.sum(F.when(F.col("_opens"), -F.col(c)).otherwise(F.col(c)))
    held = passed.groupBy(*names).agg(*[less(c).alias(c) for c in running]).where("_n_ > 0")
    place = {c: i for i, c in enumerate(value)}
    sums = []
    for out, c in totals.items():
        total = F.when(F.col(f"_c{place[c]}_") > 0, F.col(f"_v{place[c]}_"))
        sums.append((total.cast("double") if c in reals else total).alias(out))
    done = held.select(*[F.col(n).alias(c) for n, c in zip(names, per)], F.col("_n_").alias(count), *sums)
    if not odd:
        return done
    met = pairs(events.where(~plain)).select(*per, F.lit(1).cast("bigint").alias(count), *[F.col(c).alias(out) for out, c in totals.items()])
    return done.unionByName(met).groupBy(*per).agg(F.sum(count).alias(count), *[F.sum(out).alias(out) for out in totals])


def match_indicators(df: DataFrame, iocs: DataFrame, key: list[str], fields: list[str], mode: str = "enriched") -> DataFrame:
    """Indicators (indicator, threat) found in any of the fields.

    enriched: one row per key, field and threat; flag: the input rows that match.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f)).alias("value")) for f in fields])
    long = df.select(*key, F.explode(pairs).alias("_p")).select(*key, "_p.*")
    bad = iocs.select(F.lower("indicator").alias("value"), "threat").distinct()
    if mode == "enriched":
        return long.join(bad, "value").select(*key, "field", "value", "threat")
    hit = long.join(bad, "value", "left_semi").select(*key).distinct()
    return df.join(hit, key, "left_semi")


def staff_report(departments: DataFrame, jobs: DataFrame, employees: DataFrame) -> DataFrame:
    """Employees with job title, department and manager name (null for the top)."""
    boss = employees.select(F.col("employee_id").alias("manager_id"), F.col("name").alias("manager_name"))
    return employees.join(jobs, "job_id").join(departments, "department_id").join(boss, "manager_id", "left")


def top_staff(report: DataFrame, n: int = 5) -> DataFrame:
    """The n best paid per department, ties by employee id."""
    return top_per_key(report, ["department_name"], [F.col("salary").desc(), F.col("employee_id")], n)

