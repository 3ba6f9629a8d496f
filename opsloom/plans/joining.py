"""Join helpers: null-safe keys, salted hot keys, joins on ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.plans.storage import cut_lineage


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where two null keys match; the keys appear once, from the left side."""
    names = {k: f"_r_{i}" for i, k in enumerate(on)}
    renamed = right.withColumnsRenamed(names)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(renamed, cond, how).drop(*names.values())


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 16, spread: list[str] | None = None
) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salts`` tasks.

    Every row of ``big`` takes one salt from its own content, every row of
    ``small`` is repeated once per salt.  Inner, left, left_semi and left_anti
    keep their meaning, since each big row still meets all partners of its key.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    content = [F.col(c) for c in (spread or big.columns)]
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*content), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def split_join(big: DataFrame, small: DataFrame, on: str, rows: int = 1_000_000, count: str | None = None) -> DataFrame:
    """Inner equi-join in which no key of ``big`` with more than ``rows`` rows is shuffled as one.

    ``count`` names a column of ``small`` with the number of rows of the key in ``big`` (counted here if
    there is none); keys of ``small`` are unique.  Keys above the limit are few, at most the rows of
    ``big`` by ``rows``, and meet their rows where these are; all others take the plain join.
    """
    if count is None:
        count = "_rows"
        small = small.join(big.groupBy(on).agg(F.count("*").alias(count)), on)
    hot = small.where(F.col(count) > rows).withColumn("_hot", F.lit(True))
    hot = hot.drop("_rows") if count == "_rows" else hot
    extra = [c for c in hot.columns if c not in (on, "_hot")]
    # the hot keys are known by now, and their rows leave the shuffle before it
    marked = big.join(F.broadcast(cut_lineage(hot)), on, "left")
    near = marked.where("_hot").select(*big.columns, *extra)
    cold = small.where(F.col(count) <= rows).select(on, *extra)
    far = marked.where("_hot IS NULL").select(*big.columns).join(cold, on)
    return near.unionByName(far)


def share_of(value: Column, total: Column, digits: int = 6) -> Column:
    return F.round(value / F.nullif(total, F.lit(0)), digits)
