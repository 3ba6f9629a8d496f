"""Entity readers and writers: files, patterns, SQL, JDBC ranges, schema drift."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.operators.columns import group_names

FORMATS = ("csv", "json", "parquet", "orc", "text", "avro")


def _options(fmt: str, opts: dict) -> dict:
    """Reader and writer options; ``control_chars`` accepts raw control characters in JSON strings."""
    out = dict(opts)
    if fmt == "csv":
        out.setdefault("header", True)
    if out.pop("control_chars", False):
        out["allowUnquotedControlChars"] = True
    return out


def _known(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {FORMATS}")


def _run(fmt: str, action):
    """Avro is an extra module of Spark; say so where it is missing."""
    try:
        return action()
    except AnalysisException as e:
        if fmt == "avro" and "data source: avro" in str(e):
            raise ValueError("format avro needs the spark-avro module on the class path") from e
        raise


def read_entity(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None, **opts) -> DataFrame:
    """Read a file entity; a given schema avoids a pass for inference.  Compression follows the file extension."""
    _known(fmt)
    reader = spark.read.options(**_options(fmt, opts))
    if schema is not None:
        reader = reader.schema(schema)
    return _run(fmt, lambda: reader.format(fmt).load(path))


def write_entity(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None,
    max_records: int | None = None, **opts,
) -> None:
    """Write a target; ``compression`` and other writer options pass through.

    With ``partition_by`` the rows are brought together by folder first, and Spark splits what is
    large and joins what is small by measured size: a folder gets few files, a hot one several.
    """
    _known(fmt)
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).options(**_options(fmt, opts)).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    _run(fmt, lambda: writer.save(path))


def read_pattern(
    spark: SparkSession, root: str, glob: str, regex: str, fmt: str = "json", schema: T.StructType | str | None = None, **opts
) -> DataFrame:
    """Many files as one logical table; named groups of the path pattern become columns."""
    df = read_entity(spark, root, fmt, schema, pathGlobFilter=glob, recursiveFileLookup=True, **opts)
    path = F.col("_metadata.file_path")
    cols = [F.regexp_extract(path, regex, i).alias(n) for n, i in group_names(regex).items()]
    return df.select("*", *cols)


def read_sql(spark: SparkSession, text: str, args: dict | None = None, **views: DataFrame) -> DataFrame:
    """A query as an entity; ``{name}`` stands for a DataFrame given by keyword, ``:name`` for an argument."""
    return spark.sql(text, args=args or {}, **views)


def key_ranges(df: DataFrame, key: str, n: int) -> DataFrame:
    """n ranges [lo, hi) that cover a whole-number key: (part, lo, hi)."""
    bounds = df.agg(F.min(key).cast("bigint").alias("_min"), F.max(key).cast("bigint").alias("_max")).where("_min IS NOT NULL")
    width = F.ceil((F.col("_max") - F.col("_min") + 1) / n)
    rows = bounds.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    lo = F.col("_min") + F.col("part") * width
    return rows.select("part", lo.alias("lo"), F.least(lo + width, F.col("_max") + 1).alias("hi")).where("lo < hi")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lo: int, hi: int, n: int, **opts) -> DataFrame:
    """Read a table over JDBC with n parallel key ranges."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lo, upperBound=hi, numPartitions=n, properties=opts)


def read_with_drift(
    df: DataFrame, expected: T.StructType, on_extra: str = "ignore", on_missing: str = "allow", on_type: str = "allow"
) -> DataFrame:
    """Bring a frame to an expected schema.

    Each policy is allow, ignore or fail.  Extra columns: allow keeps them,
    ignore drops them.  Missing: allow adds nulls, ignore leaves them out.
    Type: allow casts (bad values become null), ignore keeps the type found.
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    wanted = {f.name: f.dataType for f in expected.fields}
    extra = [c for c in found if c not in wanted]
    missing = [c for c in wanted if c not in found]
    differ = [c for c in wanted if c in found and found[c] != wanted[c]]
    for policy, names, what in ((on_extra, extra, "extra"), (on_missing, missing, "missing"), (on_type, differ, "changed")):
        if policy == "fail" and names:
            raise ValueError(f"{what} columns: {names}")
    cols = []
    for name, kind in wanted.items():
        if name in missing:
            if on_missing == "allow":
                cols.append(F.lit(None).cast(kind).alias(name))
        elif name in differ and on_type == "allow":
            cols.append(F.col(name).try_cast(kind).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols, *(extra if on_extra == "allow" else []))


def export_partitioned(df: DataFrame, path: str, by: dict[str, str], fmt: str = "json", max_records: int | None = None) -> None:
    """Archive in time-bucketed folders; ``by`` maps a folder column to its expression."""
    rows = df.withColumns({n: F.expr(e) for n, e in by.items()})
    write_entity(rows, path, fmt, partition_by=list(by), max_records=max_records)


def take_up_to(df: DataFrame, limit: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def page_after(df: DataFrame, order: list[str], last: list | None, size: int) -> DataFrame:
    """The next page after a key; a keyset filter instead of an offset, so no page is read twice."""
    if last is not None:
        seen = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, last)])
        df = df.where(F.struct(*order) > seen)
    return df.orderBy(*order).limit(size)
