"""Usage, cost, budgets, rating and roll-ups."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.aggs import pivot
from opsloom.operators.logs import anomaly_points
from opsloom.operators.metrics import forecast_series
from opsloom.plans.closure import sum_up_tree
from opsloom.plans.joining import null_safe_join
from opsloom.plans.ordered import top_per_key
from opsloom.plans.predicates import to_column
from opsloom.plans.storage import cut_lineage
from opsloom.plans.timing import bucket, fill_gaps

# fixed values: relative ranges in whole days before the given day
RELATIVE_DAYS = {"LAST_7_DAYS": 7, "LAST_30_DAYS": 30, "LAST_90_DAYS": 90, "LAST_YEAR": 365}


def date_range(start: str, end: str | None, as_of: str | None = None) -> tuple[str, str]:
    """[start, end) as dates; a relative name counts back from ``as_of``."""
    if start in RELATIVE_DAYS:
        last = date.fromisoformat(as_of)
        return (last - timedelta(days=RELATIVE_DAYS[start])).isoformat(), last.isoformat()
    return start, end


def usage(
    df: DataFrame, ts: str, start: str, end: str | None, granularity: str, group_by: list[str], measures: dict[str, str],
    cond=None, as_of: str | None = None,
) -> DataFrame:
    """Summarised usage: range filter, nested condition on dimensions and tags, one row per period and group."""
    lo, hi = date_range(start, end, as_of)
    rows = df.where((F.col(ts) >= F.lit(lo).cast("timestamp_ntz")) & (F.col(ts) < F.lit(hi).cast("timestamp_ntz")))
    if cond is not None:
        rows = rows.where(to_column(cond))
    return rows.groupBy(bucket(ts, granularity).alias("period"), *group_by).agg(*[F.expr(e).alias(n) for n, e in measures.items()])


def cost_forecast(df: DataFrame, ts: str, group_by: list[str], cost: str, horizon: int) -> DataFrame:
    """Linear forecast of the monthly cost; x counts months since year 0."""
    month = (F.year(ts) * 12 + F.month(ts) - 1).cast("bigint")
    series = df.groupBy(*group_by, month.alias("x")).agg(F.expr(cost).alias("y"))
    return forecast_series(series, group_by, horizon)


def cost_table(df: DataFrame, path: str, depth: int, key: str, values: list, measures: dict[str, str]) -> DataFrame:
    """Cost per compartment path cut to ``depth`` levels, one column per value of ``key``."""
    node = F.array_join(F.slice(F.split(F.col(path), "/"), 1, depth), "/")
    return pivot(df.withColumn("node", node), ["node"], key, values, measures)


def carbon(df: DataFrame, factors: DataFrame, on: list[str], quantity: str, by: list[str]) -> DataFrame:
    """Quantity x emission factor, added up; quantity is summed per factor key before the join.

    ``unrated`` is the quantity without a factor, which is in no emission.
    """
    sums = df.groupBy(*list(dict.fromkeys([*on, *by]))).agg(F.sum(quantity).alias("_q"))
    return sums.join(factors, on, "left").groupBy(*by).agg(
        F.sum(F.col("_q") * F.col("factor")).alias("emission"), F.sum(F.when(F.col("factor").isNull(), F.col("_q")).otherwise(0.0)).alias("unrated")
    )


def budget_status(
    spend: DataFrame, budgets: DataFrame, key: str, ts: str, cost: str, rules: list[tuple[str, float]]
) -> DataFrame:
    """First day of each month on which a rule is met.

    Rules are (actual | forecast, percent of the monthly budget); the forecast
    extends the spend to date evenly over the month.  A month of spend without a budget
    gives one row ``unbudgeted`` without a threshold.
    """
    daily = spend.groupBy(key, bucket(ts, "month").alias("month"), F.to_date(ts).alias("day")).agg(F.sum(cost).alias("_c"))
    w = Window.partitionBy(key, "month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("actual", F.sum("_c").over(w)).join(budgets, key, "left")
    ahead = F.col("actual") / F.dayofmonth("day") * F.dayofmonth(F.last_day("day"))
    value = {"actual": F.col("actual"), "forecast": ahead}
    met = [
        F.when(F.round(value[kind] * 100 / F.col("budget"), 6) >= pct, F.struct(F.lit(kind).alias("kind"), F.lit(float(pct)).alias("threshold")))
        for kind, pct in rules
    ]
    none = F.struct(F.lit("unbudgeted").alias("kind"), F.lit(None).cast("double").alias("threshold"))
    found = F.when(F.col("budget").isNull(), F.array(none)).otherwise(F.array_compact(F.array(*met)))
    hits = daily.withColumn("_r", F.explode(found))
    return hits.groupBy(key, "month", F.col("_r.kind").alias("kind"), F.col("_r.threshold").alias("threshold")).agg(F.min("day").alias("first_day"))


def cost_anomalies(df: DataFrame, by: list[str], dim: str, ts: str, cost: str, n: int, k: float) -> DataFrame:
    """Anomalous days of the cost per group, with the dimension value that grew most against its own mean."""
    fine = cut_lineage(df.groupBy(*by, dim, bucket(ts, "day").alias("bucket")).agg(F.sum(cost).alias("v")))
    total = fine.groupBy(*by, "bucket").agg(F.sum("v").alias("v"))
    bad = cut_lineage(anomaly_points(fill_gaps(total, by, "day", {"v": 0.0}), by, "bucket", "v", n, k))
    # the bad days are few: only their spans of days are looked at, and no series is filled
    day = F.expr("INTERVAL 1 DAY")
    spans = bad.select(*by, F.col("bucket").alias("_day"), F.explode(F.sequence(F.col("bucket") - n * day, F.col("bucket"), day)).alias("bucket"))
    today = F.col("bucket") == F.col("_day")
    spent = null_safe_join(fine, spans, [*by, "bucket"]).groupBy(*by, F.col("_day").alias("bucket"), dim).agg(
        F.sum(F.when(today, F.col("v")).otherwise(0.0)).alias("_v"), F.sum(F.when(today, 0.0).otherwise(F.col("v"))).alias("_before")
    )
    # a value without cost in the span has grown by nothing
    joined = null_safe_join(null_safe_join(bad, fine.select(*by, dim).distinct(), by), spent, [*by, "bucket", dim], "left")
    growth = F.coalesce("_v", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0)) / n
    joined = joined.withColumn("_growth", F.round(growth, 4))
    first = top_per_key(joined, [*by, "bucket"], [F.col("_growth").desc(), F.col(dim)], 1, "_rn")
    return first.select(*by, "bucket", F.col("v").alias("cost"), "mean", F.col(dim).alias("root_cause"), F.col("_growth").alias("growth"))


def anomaly_summary(events: DataFrame, by: list[str], ts: str, cost: str, mean: str) -> DataFrame:
    return events.groupBy(*by).agg(
        F.count("*").alias("anomalies"), F.sum(F.col(cost) - F.col(mean)).alias("impact"), F.min(ts).alias("first"), F.max(ts).alias("last")
    )


def tiered_price(quantity: Column, tiers: list[tuple[float, float]]) -> Column:
    """Graduated price: tiers are (from quantity, unit price), each priced only for its own part."""
    total = F.lit(0.0)
    for i, (low, price) in enumerate(tiers):
        upper = quantity if i + 1 == len(tiers) else F.least(quantity, F.lit(float(tiers[i + 1][0])))
        total = total + F.greatest(upper - F.lit(float(low)), F.lit(0.0)) * F.lit(float(price))
    return total


def rate(df: DataFrame, by: list[str], quantity: str, tiers: list[tuple[float, float]]) -> DataFrame:
    """Quantity per group and its graduated price."""
    sums = df.groupBy(*by).agg(F.sum(quantity).alias("quantity"))
    return sums.withColumn("price", tiered_price(F.col("quantity"), tiers))


def burn_down(df: DataFrame, commitments: DataFrame, key: str, ts: str, cost: str) -> DataFrame:
    """Monthly use of a commitment: part covered, balance left and overage; without a commitment all use is overage."""
    monthly = df.groupBy(key, bucket(ts, "month").alias("month")).agg(F.sum(cost).alias("used"))
    w = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    rows = monthly.withColumn("_sum", F.sum("used").over(w)).join(commitments, key, "left")
    before = F.greatest(F.coalesce(F.col("commitment"), F.lit(0.0)) - (F.col("_sum") - F.col("used")), F.lit(0.0))
    covered = F.least(F.col("used"), before)
    return rows.select(
        key, "month", "used", covered.alias("covered"), (before - covered).alias("balance"), (F.col("used") - covered).alias("overage")
    )


def availability(used: DataFrame, limits: DataFrame, on: list[str]) -> DataFrame:
    """Used, free and percent per limit; a limit nobody uses has used 0."""
    n = F.coalesce(F.col("used"), F.lit(0))
    return limits.join(used, on, "left").select(
        *on, "limit", n.alias("used"), F.greatest(F.col("limit") - n, F.lit(0)).alias("free"), F.try_divide(n * 100.0, F.col("limit")).alias("percent")
    )


def tree_rollup(values: DataFrame, tree: DataFrame, measures: list[str]) -> DataFrame:
    """Value of each node including all descendants; ``tree`` is (node, parent)."""
    return sum_up_tree(values, tree, measures)


def tag_report(df: DataFrame, tags: str, required: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows with and without each required tag."""
    has = F.array(*[F.struct(F.lit(r).alias("tag"), F.coalesce(F.map_contains_key(tags, r), F.lit(False)).alias("has")) for r in required])
    long = df.select(*(by or []), F.explode(has).alias("_t")).select(*(by or []), "_t.*")
    return long.groupBy(*(by or []), "tag").agg(F.count_if("has").alias("tagged"), F.count_if(~F.col("has")).alias("untagged"))


def billing_schedule(lines: DataFrame, start: str, months: str, amount: str, by: list[str]) -> DataFrame:
    """Lines spread evenly over their months, added up per invoice month."""
    spread = lines.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col(months) - 1)))
    period = F.add_months(F.trunc(F.to_date(start), "month"), F.col("_i"))
    return spread.groupBy(*by, period.alias("invoice_month")).agg(
        F.sum(F.col(amount) / F.col(months)).alias("amount"), F.count("*").alias("lines")
    )
