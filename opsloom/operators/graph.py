"""Lineage, glossary, dependency audits and security posture; versions are in ``versions``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.aggs import aggregate, analytics
from opsloom.operators.versions import worst_scores
from opsloom.plans.closure import reach, sum_up_tree
from opsloom.plans.predicates import AllOf, AnyOf, Cond, Negate, first_match, to_column
from opsloom.plans.storage import cut_lineage
from opsloom.plans.timing import bucket, fill_gaps


def lineage(edges: DataFrame, starts: DataFrame, direction: str = "downstream", depth: int | None = None) -> DataFrame:
    """All nodes down- or upstream of each start (up to ``depth``, if given), with the shortest distance; cycles are harmless."""
    if direction == "upstream":
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(edges, starts, depth).where("depth > 0")


def glossary_tree(terms: DataFrame) -> DataFrame:
    """Terms (node, parent) with direct children and all descendants."""
    children = terms.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    ones = terms.select("node", F.lit(1).cast("bigint").alias("below"))
    total = sum_up_tree(ones, terms, ["below"]).withColumn("descendants", F.col("below") - 1)
    return total.join(children, "node", "left").select("node", F.coalesce("children", F.lit(0)).alias("children"), "descendants")


def suggest(df: DataFrame, col: str, prefix: str, limit: int, max_edits: int | None = None) -> DataFrame:
    """Most frequent terms that start with a prefix, or lie within some edits of it."""
    value = F.lower(F.col(col))
    hit = F.startswith(value, F.lit(prefix.lower())) if max_edits is None else F.levenshtein(value, F.lit(prefix.lower())) <= max_edits
    counts = df.where(hit).groupBy(col).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), col).limit(limit)


def vulnerability_audit(deps: DataFrame, versions: DataFrame, advisories: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Worst advisory score of each component and of everything it depends on.

    ``deps`` is (src, dst): src needs dst.  A score travels from dst to src, and
    only components whose score rises travel on, so the work per round is the
    changed part of the graph.  Scores only rise, and only to scores that occur, so it ends.
    """
    links = cut_lineage(deps.select("src", "dst").distinct())
    own = worst_scores(versions, advisories, ignore).select(F.col("component").alias("node"), "score")
    best = moved = cut_lineage(own)
    while True:
        up = moved.join(links, moved["node"] == links["dst"]).groupBy(F.col("src").alias("node")).agg(F.max("score").alias("score"))
        known = best.groupBy("node").agg(F.max("score").alias("_old"))
        moved = up.join(known, "node", "left").where(F.col("_old").isNull() | (F.col("score") > F.col("_old"))).select("node", "score")
        moved = cut_lineage(moved)
        if moved.isEmpty():
            break
        best = cut_lineage(best.unionByName(moved).groupBy("node").agg(F.max("score").alias("score")))
    return best.groupBy("node").agg(F.max("score").alias("score"))


def match_conditions(df: DataFrame, tree, lists: dict[str, DataFrame] | None = None) -> DataFrame:
    """Nested AND / OR / NOT conditions; ``member`` tests a column against a named list.

    ``lists`` are one-column frames of any size: each becomes one left join on
    its distinct values, so a list is never part of the expression.
    """
    names = {}

    def prepare(t):
        if isinstance(t, Cond) and t.op == "member":
            flag = f"_in_{len(names)}"
            names[flag] = t
            return F.coalesce(F.col(flag), F.lit(False))
        if isinstance(t, AllOf):
            return reduce(lambda a, b: a & b, [prepare(p) for p in t.parts])
        if isinstance(t, AnyOf):
            return reduce(lambda a, b: a | b, [prepare(p) for p in t.parts])
        if isinstance(t, Negate):
            return ~prepare(t.part)
        return to_column(t)

    cond = prepare(tree)
    rows = df
    for flag, t in names.items():
        members = lists[t.value]
        members = members.select(F.col(members.columns[0]).alias(t.field)).distinct().withColumn(flag, F.lit(True))
        rows = rows.join(members, t.field, "left")
    return rows.where(cond).select(*df.columns)


def problems(df: DataFrame, dims: list[str], ts: str, period: str) -> DataFrame:
    """Problem counts per period and dimension with the change to the period before.

    Every group has a row for every period between the first and the last of all; one without a problem counts 0.
    """
    rows = df.withColumn("period", bucket(ts, period))
    counts = analytics(rows, ["period", *dims], {"n": "count(*)"}, [["period"], *[["period", d] for d in dims]])
    counts = fill_gaps(counts, ["level", *dims], period, {"n": 0}, "period")
    w = Window.partitionBy("level", *dims).orderBy("period")
    return counts.withColumn("change", F.col("n") - F.lag("n").over(w))


def risk_score(df: DataFrame, resource: str, kind: str, ts: str, weights: dict[str, float], as_of: str, half_life_days: float) -> DataFrame:
    """Sum of weights that halve every half life, per resource, with the share of the total."""
    weight = first_match([(Cond(kind, "=", k), float(w)) for k, w in weights.items()], 0.0)
    age = F.timestamp_diff("SECOND", F.col(ts), F.lit(as_of).cast("timestamp_ntz")) / 86400.0
    rows = df.select(resource, (weight * F.exp(-age * 0.6931471805599453 / half_life_days)).alias("_r"))
    scores = rows.groupBy(resource).agg(F.sum("_r").alias("score"))
    return scores.withColumn("share", F.try_divide("score", scores.agg(F.sum("score")).scalar()))


def data_mask(df: DataFrame, rules: list[tuple[object, list[str]]]) -> DataFrame:
    """Blank the listed columns in the rows a rule targets."""
    out = {}
    for cond, cols in rules:
        for c in cols:
            out[c] = F.when(F.coalesce(to_column(cond), F.lit(False)), F.lit(None)).otherwise(out.get(c, F.col(c)))
    return df.withColumns(out)


def inventory(df: DataFrame, by: list[str], aggs: dict[str, str]) -> DataFrame:
    return aggregate(df, by, aggs)


def recommend_actions(metrics: DataFrame, key: str, value: str, cost: str, levels: list[tuple[str, float, str, float]]) -> DataFrame:
    """Levels are (name, highest value, advice, saving share), from low to high; above the last no advice."""
    rules = [(F.col(value) <= limit, F.struct(F.lit(n).alias("level"), F.lit(a).alias("advice"), F.lit(float(s)).alias("saving"))) for n, limit, a, s in levels]
    pick = first_match(rules, F.lit(None))
    rows = metrics.withColumn("_p", pick).where(F.col("_p").isNotNull())
    return rows.select(key, value, F.col("_p.level").alias("level"), F.col("_p.advice").alias("advice"), (F.col(cost) * F.col("_p.saving")).alias("saving"))


__all__ = [
    "lineage", "glossary_tree", "suggest", "vulnerability_audit", "match_conditions",
    "problems", "risk_score", "data_mask", "inventory", "recommend_actions",
]
