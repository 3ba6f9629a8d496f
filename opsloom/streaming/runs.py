"""Stream sources, progress per consumer group, and sinks that survive a replayed batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.plans.storage import shared_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def zoned(df: DataFrame, ts: str) -> DataFrame:
    """Event time as timestamp with zone, as watermarks require; a value without zone is read as UTC."""
    return df.withColumn(ts, F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts)).cast("timestamp"))


def utc_wall(col: str | Column) -> Column:
    """The UTC wall time of an instant, as timestamp without zone."""
    col = F.col(col) if isinstance(col, str) else col
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))


def stream_source(
    spark: SparkSession, path: str, schema: T.StructType | str, start: str = "TRIM_HORIZON", ts: str | None = None,
    fmt: str = "parquet", max_files: int | None = None, newer_than: str | None = None, progress: str | None = None,
) -> DataFrame:
    """A stream over the files of a folder, from a position.

    TRIM_HORIZON reads all; LATEST only files written after ``newer_than`` (or
    after now); any other text is a time, and rows with an earlier ``ts`` are
    left out.  A stopped query goes on from its checkpoint, not from here.  With
    ``progress``, the folder of a consumer group, LATEST is the time of the group's first
    start: it is stored there, so files that come between two runs are read by the second.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.load(path)
    if start == "TRIM_HORIZON":
        return df
    if start == "LATEST":
        since = newer_than or (_first_start(spark, progress) if progress else _now(spark))
        return df.where(F.col("_metadata.file_modification_time") > F.lit(since).cast("timestamp"))
    return df.where(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))


def _now(spark: SparkSession) -> str:
    return spark.sql("SELECT CAST(current_timestamp() AS STRING)").first()[0]


def _first_start(spark: SparkSession, progress: str) -> str:
    """The time of a consumer group's first start, kept beside its checkpoint."""
    path = f"{progress.rstrip('/')}-position"
    if not _exists(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame([(_now(spark),)], "since string").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema("since string").parquet(path).first()[0]


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch owns one folder and overwrites it, so a replayed batch leaves no second copy."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What the batches wrote, with the batch number; empty when there was none."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def run_to_end(
    df: DataFrame, label: str, mode: str = "append", progress: str | None = None, sink: Callable[[DataFrame, int], None] | None = None
) -> DataFrame:
    """Run a stream over all input that is there and return what it wrote.

    ``progress`` is the checkpoint folder of a consumer group: a second run with
    the same folder goes on where the first one stopped.  State is kept in
    RocksDB, off the heap.
    """
    spark = df.sparkSession
    out = shared_path(spark, label)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        started = (
            df.writeStream.outputMode(mode)
            .option("checkpointLocation", progress or shared_path(spark, f"{label}-progress"))
            .trigger(availableNow=True)
            .foreachBatch(sink or batch_writer(out))
            .start()
        )
        started.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    return read_result(spark, out, df.schema)


def last_update(result: DataFrame, keys: list[str]) -> DataFrame:
    """Final rows of a stream in update mode: the newest batch per key wins."""
    values = [c for c in result.columns if c not in (*keys, "batch")]
    rows = result.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return rows.select(*keys, "_v.*")


def connect(
    source: DataFrame, target: str, cond=None, task: Callable[[DataFrame], DataFrame] | None = None, progress: str | None = None
):
    """Source -> filter rule -> task -> target files; returns the started query."""
    from opsloom.plans.predicates import to_column

    rows = source if cond is None else source.where(to_column(cond))
    rows = rows if task is None else task(rows)
    return (
        rows.writeStream.option("checkpointLocation", progress or shared_path(rows.sparkSession, "connector-progress"))
        .trigger(availableNow=True)
        .foreachBatch(batch_writer(target))
        .start()
    )
