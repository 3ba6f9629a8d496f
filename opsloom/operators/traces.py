"""Trace summaries, topology, apdex, stack and probe aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.operators.columns import data_object_query
from opsloom.operators.metrics import summarize
from opsloom.plans.joining import null_safe_join, share_of
from opsloom.plans.predicates import to_column
from opsloom.plans.quantiles import exact_quantiles


def traces(spans: DataFrame) -> DataFrame:
    """Spans (trace_id, span_id, parent_id, service, start, duration_ms, error) to one row per trace."""
    finish = F.col("start") + F.make_dt_interval(secs=F.col("duration_ms") / 1000)
    root = F.when(F.col("parent_id").isNull(), F.struct("start", "span_id"))
    out = spans.withColumn("_end", finish).groupBy("trace_id").agg(
        F.min_by("service", root).alias("root_service"), F.min("start").alias("start"), F.max("_end").alias("_end"),
        F.count("*").alias("spans"), F.count_if(F.col("error") != 0).alias("errors"),
        F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"),
    )
    length = F.timestamp_diff("MICROSECOND", F.col("start"), F.col("_end")) / 1000
    return out.withColumn("duration_ms", length).drop("_end")


def trace_query(df: DataFrame, select: list[str], where=(), group=(), aggs=None, order=(), limit: int | None = None) -> DataFrame:
    """select / where / group / order / limit over spans; everything stays one Spark plan."""
    out = data_object_query(df, select, list(where), list(group), aggs, list(order))
    return out.limit(limit) if limit else out


def topology(spans: DataFrame) -> DataFrame:
    """Caller -> callee edges between services with calls, errors and latency."""
    caller = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("service").alias("caller"))
    calls = spans.join(caller, ["trace_id", "parent_id"])
    return calls.groupBy("caller", F.col("service").alias("callee")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("error") != 0).alias("errors"),
        F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"),
    )


def span_filter(df: DataFrame, cond) -> DataFrame:
    return df.where(to_column(cond))


def pinned_attributes(df: DataFrame, attributes: str, n: int) -> DataFrame:
    """The most used attribute names with their share of the spans."""
    names = df.select(F.explode(F.map_keys(attributes)).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n"))
    names = names.withColumn("share", share_of(F.col("n"), df.agg(F.count("*")).scalar()))
    return names.orderBy(F.col("n").desc(), "attribute").limit(n)


def apdex(df: DataFrame, value: str, rules: list[tuple[str, object, float]]) -> DataFrame:
    """Rules are (name, condition, satisfied limit); up to four times the limit is tolerated."""
    hits = [
        F.when(to_column(c), F.struct(F.lit(name).alias("rule"), F.lit(float(limit)).alias("t"), F.col(value).alias("v")))
        for name, c, limit in rules
    ]
    rows = df.select(F.explode(F.array_compact(F.array(*hits))).alias("r")).select("r.*")
    good = F.count_if(F.col("v") <= F.col("t"))
    fair = F.count_if((F.col("v") > F.col("t")) & (F.col("v") <= 4 * F.col("t")))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), ((good + fair / 2) / F.count("*")).alias("apdex"))


def span_metrics(spans: DataFrame, cond, interval: str, stat: str, dims: list[str], value: str = "duration_ms") -> DataFrame:
    """A derived metric: statistic of a span value per interval and dimensions, for spans meeting a condition."""
    return summarize(spans.where(to_column(cond)), "start", value, interval, stat, dims)


def aggregate_stacks(df: DataFrame, frames: str) -> DataFrame:
    """Frame-prefix tree: hits of every prefix, and how many stacks end there.

    Equal stacks are counted first, so repeated stacks are expanded once.
    """
    stacks = df.where(F.size(frames) > 0).groupBy(F.col(frames).alias("f")).agg(F.count("*").alias("c"))
    cut = F.transform(
        F.sequence(F.lit(1), F.size("f")),
        lambda i: F.struct(F.array_join(F.slice("f", F.lit(1), i), "/").alias("prefix"), i.alias("depth"), (i == F.size("f")).alias("leaf")),
    )
    long = stacks.select("c", F.explode(cut).alias("p")).select("c", "p.*")
    return long.groupBy("prefix", "depth").agg(
        F.sum("c").alias("hits"), F.sum(F.when(F.col("leaf"), F.col("c")).otherwise(0)).alias("self_hits")
    )


def probe_stats(df: DataFrame, by: list[str], latency: str, lost) -> DataFrame:
    """Loss share and latency quantiles of the answered probes per target."""
    lost = to_column(lost)
    base = df.groupBy(*by).agg(F.count("*").alias("probes"), (F.count_if(lost) / F.count("*")).alias("loss"))
    q = exact_quantiles(df.where(~lost), by, latency, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return null_safe_join(base, q, by, "left")
