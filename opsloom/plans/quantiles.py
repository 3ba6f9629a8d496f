"""Exact group quantiles by distributed selection; no group is collected or sorted in one task.

A sketch of each group (the first scan) gives every wanted rank a bracket of values that is
certain to hold it.  The second scan counts the values below the bracket and keeps, with their
counts, those inside it.  A bracket with many distinct values is narrowed: a sketch of these values
cuts it into bins, the bins are counted, and only those that hold the rank go on, until few enough
are left to be put in order.  Groups of all sizes take the same way.  Interpolation is linear between
neighbouring ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.plans.joining import null_safe_join
from opsloom.plans.storage import cut_lineage

#: Distinct values of a bracket that are put in order in one window.
BOUND = 100_000
#: Bins of a narrowing step.
BINS = 128
#: Ranks of slack on both sides of a wanted one, beyond what the sketch may be off.
_RANKS = 3


def exact_quantiles(
    df: DataFrame, by: list[str], col: str, probs: dict[str, float], accuracy: int = 10000, weight: str | None = None, bound: int = BOUND
) -> DataFrame:
    """One row per group of ``by`` with a column per quantile; groups without a value are left out.

    The sketch is written when this is called, and so is each narrowing step where one is needed;
    the rest is lazy.  ``accuracy`` and ``bound`` set the width of brackets and the size of the
    last sort; the answer is exact for any value.  With ``weight``, a row stands for that many equal
    values (null or 0: none), as in a histogram.  A rank outside its bracket would be an error, not an answer.
    """
    if weight is None:
        parts, widest = _bracketed(df.where(F.col(col).isNotNull()).select(*by, F.col(col).alias("_v")), by, list(probs.values()), accuracy)
    else:
        rows = df.where(F.col(col).isNotNull() & (F.col(weight) > 0)).select(*by, F.col(col).alias("_v"), F.col(weight).alias("_c"))
        parts, widest = _weighted(rows, by, list(probs.values())), None
    if widest is None or widest > bound:
        parts = _narrowed(parts, by, bound)
    return _picked(parts, by, list(probs))


def _position(probs: list[float], n: Column) -> Column:
    """Where the wanted rank ``_i`` lies among n values, from 0."""
    return F.element_at(F.array(*(F.lit(float(p)) for p in probs)), F.col("_i") + 1) * (n - 1)


def _bracketed(rows: DataFrame, by: list[str], probs: list[float], accuracy: int) -> tuple[DataFrame, float]:
    """``by, _i, _pos, _v, _c``: the counted values of each bracket, and under a null the count below it; and the most values a bracket can be wide."""
    # a share of the group on both sides: the least one of some that is a few ranks in a group of its size
    shares = [share for k in range(20) if (share := _RANKS / accuracy * 10**k) < 1]
    edges = sorted({min(max(p + sign * s, 0.0), 1.0) for p in probs for s in shares for sign in (-1, 1)} | {0.0, 1.0})
    sketch = cut_lineage(
        rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", edges, accuracy).alias("_edge"))
    )
    largest = sketch.agg(F.max("_n")).first()[0] or 0

    def edge(p: float, sign: int) -> Column:
        out = F.col("_min" if sign < 0 else "_max")
        for share in reversed(shares):
            at = p + sign * share
            if 0 < at < 1:
                out = F.when(F.col("_n") * share >= _RANKS, F.col("_edge")[edges.index(at)]).otherwise(out)
            else:
                out = F.when(F.col("_n") * share >= _RANKS, F.col("_min" if sign < 0 else "_max")).otherwise(out)
        return out

    low = F.array(*(edge(p, -1) for p in probs))
    high = F.array(*(edge(p, 1) for p in probs))
    sketch = sketch.select(*by, "_n", low.alias("_low"), high.alias("_high"))
    marked = null_safe_join(rows, sketch, by)
    # per wanted rank a value counts as below the bracket (no value kept), inside it, or not at all
    below = F.lit(None).cast(rows.schema["_v"].dataType)
    v = F.col("_v")
    hits = [
        F.when(v < F.col("_low")[i], F.struct(F.lit(i).alias("_i"), below.alias("_v"))).when(v <= F.col("_high")[i], F.struct(F.lit(i).alias("_i"), v.alias("_v")))
        for i in range(len(probs))
    ]
    parts = marked.select(*by, "_n", F.explode(F.array(*hits)).alias("_h")).where("_h IS NOT NULL")
    parts = parts.groupBy(*by, "_n", F.col("_h._i").alias("_i"), F.col("_h._v").alias("_v")).agg(F.count("*").alias("_c"))
    # both sides, the slack ten times too wide at worst, and the error of the sketch
    return parts.select(*by, "_i", _position(probs, F.col("_n")).alias("_pos"), "_v", "_c"), largest * 8 / accuracy + 100 * _RANKS


def _weighted(rows: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """The same from a histogram: each bracket is the whole group."""
    counts = cut_lineage(rows.groupBy(*by, "_v").agg(F.sum("_c").alias("_c")))
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    ranks = F.explode(F.array(*(F.lit(i) for i in range(len(probs)))))
    parts = null_safe_join(counts, sizes, by).withColumn("_i", ranks)
    return parts.select(*by, "_i", _position(probs, F.col("_n")).alias("_pos"), "_v", "_c")


def _narrowed(parts: DataFrame, by: list[str], bound: int) -> DataFrame:
    """Keep of each bracket the bins that hold its rank until no bracket has more than ``bound`` distinct values."""
    key = [*by, "_i"]
    parts = cut_lineage(parts)
    while True:
        sizes = parts.groupBy(*key).agg(F.count("_v").alias("_values"))
        wide = cut_lineage(sizes.where(F.col("_values") > max(bound, 2)).select(*key))
        if wide.isEmpty():
            return parts
        some = null_safe_join(parts, wide, key, "left_semi")
        cuts = some.where("_v IS NOT NULL").groupBy(*key).agg(F.percentile_approx("_v", [k / BINS for k in range(1, BINS)], 20 * BINS).alias("_cuts"))
        slot = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda cut: cut < F.col("_v"))))
        binned = cut_lineage(null_safe_join(some, cuts, key).withColumn("_bin", slot).drop("_cuts"))
        # a row per bin: the bins of a bracket in order are few
        counted = binned.groupBy(*key, "_pos", "_bin").agg(F.sum("_c").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*key).orderBy("_bin"))
        counted = cut_lineage(counted.withColumn("_upto", upto))
        passed = F.col("_upto") <= F.floor("_pos")
        holds = ~passed & (F.col("_upto") - F.col("_c") <= F.ceil("_pos")) & (F.col("_bin") >= 0)
        kept = null_safe_join(binned, counted.where(holds).select(*key, "_bin"), [*key, "_bin"], "left_semi").drop("_bin")
        below = counted.where(passed).groupBy(*key, "_pos").agg(F.sum("_c").alias("_c"))
        below = below.select(*key, "_pos", F.lit(None).cast(parts.schema["_v"].dataType).alias("_v"), "_c")
        others = null_safe_join(parts, wide, key, "left_anti")
        parts = cut_lineage(others.unionByName(kept).unionByName(below))


def _picked(parts: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """The wanted values of each group from its ordered brackets."""
    w = Window.partitionBy(*by, "_i").orderBy(F.col("_v").asc_nulls_first())
    ranked = parts.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a rank among the values below the bracket would be null here, as would one above it
    first = lambda rank: F.min(F.when(F.col("_upto") > rank, F.struct("_upto", "_v")))["_v"]
    edge = ranked.groupBy(*by, "_i").agg(F.max("_pos").alias("_pos"), first(F.floor("_pos")).alias("_a"), first(F.ceil("_pos")).alias("_z"))
    value = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    value = F.when(F.col("_a").isNull() | F.col("_z").isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).otherwise(value.cast("double"))
    return edge.groupBy(*by).agg(*(F.max(F.when(F.col("_i") == i, value)).alias(name) for i, name in enumerate(names)))
