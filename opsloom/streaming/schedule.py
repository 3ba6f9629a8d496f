"""Continuous queries: a batch query run once per due time, whatever happens to the stream that wakes it.

The due times are ``start``, ``start + every`` and so on.  A stream of ticks tells how late it is;
each micro-batch runs what has come due and is not yet done.  A run is done once its folder below
the target is complete, so the runs themselves are the stored state: a repeated batch, a restart
with the same or another checkpoint, or a tick that comes twice finds them and runs nothing, and due times
missed while the stream was down are run when it is back.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.plans.storage import shared_path
from opsloom.streaming.runs import utc_wall

_STAMP = "%Y%m%dT%H%M%S"


def clock(spark: SparkSession) -> DataFrame:
    """A tick per second (``ts``, UTC without zone), for a schedule by the time of day."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(utc_wall("timestamp").alias("ts"))


def due_times(start: datetime, every: timedelta, now: datetime) -> list[datetime]:
    """All due times up to ``now``."""
    if every <= timedelta(0):
        raise ValueError("the step of a schedule must be above zero")
    count = (now - start) // every + 1 if now >= start else 0
    return [start + k * every for k in range(count)]


def runs_done(spark: SparkSession, target: str) -> set[str]:
    """Names of the complete runs below the target."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/due=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return {status.getPath().getParent().getName().removeprefix("due=") for status in found}


def run_due(spark: SparkSession, report: Callable[[SparkSession, datetime], DataFrame], target: str, start: datetime, every: timedelta, now: datetime) -> list[datetime]:
    """Run the report for each due time up to ``now`` that has no complete run; returns those times."""
    done = runs_done(spark, target)
    ran = []
    for number, due in enumerate(due_times(start, every, now)):
        name = due.strftime(_STAMP)
        if name not in done:
            rows = report(spark, due).withColumns({"run": F.lit(number).cast("bigint"), "run_time": F.lit(due).cast("timestamp_ntz")})
            rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/due={name}")
            ran.append(due)
    return ran


def scheduled(
    ticks: DataFrame, ts: str, report: Callable[[SparkSession, datetime], DataFrame], target: str, start: datetime, every: timedelta,
    progress: str | None = None, trigger: dict | None = None,
):
    """Start a stream of ticks that runs ``report(spark, due)`` once for every due time reached; returns the started query.

    ``ts`` is the column of a tick that holds its time; a batch without a time runs nothing.  With
    ``trigger``, such as ``{"processingTime": "1 minute"}``, the stream goes on; by default it ends with the ticks at hand.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        now = df.agg(F.max(ts).cast("timestamp_ntz")).first()[0]
        if now is not None:
            run_due(df.sparkSession, report, target, start, every, now)

    return (
        ticks.writeStream.option("checkpointLocation", progress or shared_path(ticks.sparkSession, "scheduled-progress"))
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(batch)
        .start()
    )


def results(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """Rows of all complete runs with ``run`` and ``run_time``; ``schema`` is that of the report."""
    full = T.StructType([*schema.fields, T.StructField("run", T.LongType()), T.StructField("run_time", T.TimestampNTZType())])
    paths = [f"{target.rstrip('/')}/due={name}" for name in sorted(runs_done(spark, target))]
    return spark.read.schema(full).parquet(*paths) if paths else spark.createDataFrame([], full)
