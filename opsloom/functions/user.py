"""User-defined scalar, batch, aggregate and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession, name: str, fn: Callable[..., pd.Series], returns: str):
    """A scalar function over pandas Series (Arrow batches), usable in SQL and on columns."""
    udf = F.pandas_udf(fn, returns)
    return spark.udf.register(name, udf)


def register_sql(spark: SparkSession, name: str, signature: str, returns: str, body: str) -> None:
    """A SQL function: stays inside the JVM and is inlined into the plan."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS {returns} RETURN {body}")


def apply_function(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user function over batches of rows; batches are cut by Spark, so fn must not depend on them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def register_agg(spark: SparkSession, name: str, fn: Callable[[pd.Series], float], returns: str):
    """A grouped aggregate over a whole group at once; for groups known to be small."""
    return spark.udf.register(name, F.pandas_udf(fn, returns))


def aggregate_with(
    df: DataFrame, by: list[str], partial: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame],
    finish: Column, state_schema: str, out: str, salts: int = 32,
) -> DataFrame:
    """A user aggregate for groups of any size.

    ``partial`` reduces one Arrow batch to one state row per group (keys and
    state columns), ``merge`` reduces state rows of one group to one.  States
    meet first per (group, salt) and then per group; ``finish`` turns the state
    columns into the result.
    """
    states = df.mapInPandas(lambda batches: (partial(pdf) for pdf in batches if len(pdf)), state_schema)
    salted = states.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    first = salted.groupBy(*by, "_salt").applyInPandas(lambda pdf: merge(pdf.drop(columns="_salt")), state_schema)
    return first.groupBy(*by).applyInPandas(merge, state_schema).select(*by, finish.alias(out))


def register_table_fn(spark: SparkSession, name: str, handler: type, returns: str):
    """A table function (class with an ``eval`` generator) for lateral joins in SQL."""
    udtf = F.udtf(handler, returnType=returns)
    spark.udtf.register(name, udtf)
    return udtf
