"""Entity selection, log and metric ingest, object inventories and lifecycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.plans.ordered import ordered_window
from opsloom.plans.predicates import first_match, wildcard_regex


def select_entities(names: DataFrame, col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Names kept by (include | exclude, wildcard) rules; the last matching rule decides, no match excludes."""
    chain = [(F.col(col).rlike(wildcard_regex(pattern)), action) for action, pattern in reversed(rules)]
    return names.where(first_match(chain, "exclude") == "include")


def ingest_logs(df: DataFrame) -> DataFrame:
    """Batches (source, type, default_time, entries of id, time, type, data) to one row per entry; the header fills gaps."""
    e = df.withColumn("e", F.explode("entries"))
    return e.select(
        "source", F.col("e.id").alias("id"), F.coalesce("e.time", "default_time").alias("time"),
        F.coalesce("e.type", "type").alias("type"), F.col("e.data").alias("data"),
    )


def ingest_metrics(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts (namespace, name, dimensions map, datapoints of ts, value) to good points and rejects with a reason."""
    points = df.select("namespace", "name", "dimensions", F.explode_outer("datapoints").alias("p")).select(
        "namespace", "name", "dimensions", F.col("p.ts").alias("ts"), F.col("p.value").alias("value")
    )
    reason = (
        F.when(F.col("name").isNull() | (F.col("name") == ""), "MISSING_NAME")
        .when(F.coalesce(F.size("dimensions"), F.lit(-1)) < 1, "NO_DIMENSION")
        .when(F.col("ts").isNull(), "NO_TIMESTAMP")
        .when(F.col("value").isNull(), "NO_VALUE")
    )
    marked = points.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def list_objects(inv: DataFrame, prefix: str = "", delimiter: str = "/", name: str = "name", size: str = "bytes") -> DataFrame:
    """Common prefixes below a prefix, with object count and bytes; an object without delimiter lists itself."""
    rest = F.substring(F.col(name), F.lit(len(prefix) + 1), F.length(name))
    cut = F.instr(rest, F.lit(delimiter))
    head = F.when(cut > 0, F.substring(rest, F.lit(1), cut + (len(delimiter) - 1))).otherwise(rest)
    rows = inv.where(F.startswith(F.col(name), F.lit(prefix))).withColumn("prefix", F.concat(F.lit(prefix), head))
    return rows.groupBy("prefix").agg(F.count("*").alias("objects"), F.sum(size).alias("bytes"))


@dataclass(frozen=True)
class LifecycleRule:
    """``action`` is due once an object under ``prefix`` (and matching ``pattern``) is ``days`` old."""

    action: str
    days: int
    prefix: str = ""
    pattern: str | None = None


def lifecycle_actions(
    inv: DataFrame, rules: list[LifecycleRule], as_of: str, name: str = "name", modified: str = "modified", retention_days: int = 0
) -> DataFrame:
    """The due action of the rule with the most days; objects inside the retention time are never deleted."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date(modified))

    def due(r: LifecycleRule) -> Column:
        cond = F.startswith(F.col(name), F.lit(r.prefix)) & (age >= r.days)
        if r.pattern:
            cond = cond & F.col(name).rlike(wildcard_regex(r.pattern))
        return cond & (age >= retention_days) if r.action == "DELETE" else cond

    ordered = sorted(rules, key=lambda r: (-r.days, r.action))
    rows = inv.withColumns({"age_days": age, "action": first_match([(due(r), r.action) for r in ordered])})
    return rows.where(F.col("action").isNotNull())


def pages(df: DataFrame, order: list[str], size: int, chunk: Column) -> DataFrame:
    """Stable page number and position of every row in the given order.

    Rows are numbered inside blocks of the order and shifted by the size of the
    blocks before, so the table is never sorted in one task.
    """
    numbered = ordered_window(df, [], order, chunk, number="_n")
    return numbered.withColumns(
        {"page": F.floor((F.col("_n") - 1) / size) + 1, "position": F.pmod(F.col("_n") - 1, F.lit(size)) + 1}
    ).drop("_n")
