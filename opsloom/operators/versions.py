"""Versions in order, advisories by version range, and upgrades out of them.

Each component's versions and the bounds of its advisories are put in one order and swept once:
running counts say how many versions lie before a bound and how many ranges are open at a
version.  What an advisory hits is then a stretch of version numbers, so no version meets a
version or a range that it is not in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.plans.ordered import ordered_window
from opsloom.plans.storage import cut_lineage

# fixed values: words that name a version before the release itself, also without a dash in front
BEFORE_RELEASE = ["a", "alpha", "b", "beta", "c", "dev", "m", "milestone", "pre", "preview", "rc", "snapshot"]

_PRE, _END, _NUMBER, _TEXT = 0, 1, 2, 3
_BOUND, _VERSION = 0, 1


def version_key(version: Column) -> Column:
    """A version as an array that orders like it.

    Numbers compare as numbers and words as text, a number before a word; a version that goes on is
    later than one that ends, except by a pre-release: what follows a dash, or one of
    ``BEFORE_RELEASE``, comes before the release (``2.0-rc1 < 2.0-rc2 < 2.0 < 2.0.1``).  Case, a
    leading v and build data behind + do not count.  Null stays null.
    """
    text = F.regexp_replace(F.regexp_replace(F.lower(version), r"[+].*$", ""), r"^\s*v(?=[0-9])", "")
    # a mark in front of the first pre-release word, then the numbers and words in turn
    marked = F.regexp_replace(text, f"^([^-]*?)(?:-|[._]?(?=(?:{'|'.join(BEFORE_RELEASE)})(?:[^a-z]|$)))", "$1 ! ")
    tokens = F.regexp_extract_all(marked, F.lit(r"([0-9]+|[a-z]+|!)"))
    part = lambda kind, number, word: F.struct(F.lit(kind).alias("kind"), number.cast("decimal(38,0)").alias("number"), word.cast("string").alias("word"))
    none = F.lit(None)
    each = lambda x: F.when(x == "!", part(_PRE, none, none)).when(x.rlike("^[0-9]"), part(_NUMBER, x.try_cast("decimal(38,0)"), none)).otherwise(part(_TEXT, none, x))
    return F.when(version.isNotNull(), F.concat(F.transform(tokens, each), F.array(part(_END, none, none))))


def _major(key: str) -> Column:
    """Grows with the order of keys: the first number; words come last."""
    first = F.col(key)[0]
    return F.when(first["kind"] == _NUMBER, first["number"]).when(first["kind"] == _TEXT, F.lit("9" * 38).cast("decimal(38,0)")).otherwise(F.lit(-1).cast("decimal(38,0)"))


def _sweep(versions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Versions (``component, version, key``) and range bounds (``component, id, low, high``) in one order.

    Gives ``component, kind, version, id, side, before, open``: the versions before the row, and the
    ranges open at it.  A component's rows are cut by major version, so one component may hold most of them.
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    points = versions.select("component", "key", F.lit(_VERSION).alias("kind"), "version", number.alias("id"), F.lit(0).alias("side"), F.lit(1).alias("one"), F.lit(0).alias("opens"))
    bound = lambda name, side: ranges.where(F.col(name).isNotNull()).select("component", F.col(name).alias("key"), F.lit(_BOUND).alias("kind"), text.alias("version"), "id", F.lit(side).alias("side"), F.lit(0).alias("one"), F.lit(side).alias("opens"))
    rows = points.unionByName(bound("low", 1)).unionByName(bound("high", -1))
    swept = ordered_window(
        rows, ["component"], ["key", "kind", "side", "id", "version"], _major("key"),
        running={"before": ("sum", F.col("one").cast("bigint")), "open": ("sum", F.col("opens").cast("bigint"))},
    )
    return swept.withColumn("before", F.col("before") - F.col("one"))


def _ranged(advisories: DataFrame) -> DataFrame:
    """Advisories with a number and the keys of their bounds; a null bound is open, and a range that ends before it begins holds nothing."""
    first = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(None).cast("decimal(38,0)").alias("number"), F.lit(None).cast("string").alias("word")))
    keyed = advisories.withColumns({"_low": F.coalesce(version_key(F.col("low")), first), "_high": version_key(F.col("high"))})
    keyed = keyed.where(F.col("_high").isNull() | (F.col("_low") < F.col("_high")))
    return cut_lineage(keyed.withColumn("_id", F.monotonically_increasing_id()))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("version").isNotNull()).select("component", "version").distinct().withColumn("key", version_key(F.col("version")))


def _live(advisories: DataFrame, ignore: list[str]) -> DataFrame:
    return advisories.where(F.col("advisory").isNull() | ~F.col("advisory").isin(list(ignore))) if ignore else advisories


def _hits(components: DataFrame, ranged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions with their number in the component, and per advisory the stretch (``first``, ``last``) of numbers inside it, if any."""
    ranges = ranged.select("component", F.col("_id").alias("id"), F.col("_low").alias("low"), F.col("_high").alias("high"))
    swept = cut_lineage(_sweep(_keyed(components), ranges))
    numbers = swept.where(F.col("kind") == _VERSION).select("component", "version", (F.col("before") + 1).alias("number"))
    ends = swept.where(F.col("kind") == _BOUND).groupBy("component", "id").agg(
        F.max(F.when(F.col("side") == 1, F.col("before"))).alias("low"), F.max(F.when(F.col("side") == -1, F.col("before"))).alias("high")
    )
    count = numbers.groupBy("component").agg(F.max("number").alias("count"))
    stretch = ends.join(count, "component").select("id", (F.col("low") + 1).alias("first"), F.coalesce("high", "count").alias("last"))
    return numbers, stretch.where(F.col("first") <= F.col("last"))


def affected(components: DataFrame, advisories: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Component versions (component, version) inside an advisory range [low, high): one row per version and advisory.

    Rows without a version or component are in no range; equal rows of ``components`` each count.
    """
    ranged = _ranged(_live(advisories, ignore))
    numbers, stretch = _hits(components, ranged)
    named = ranged.join(stretch, ranged["_id"] == stretch["id"]).withColumn("number", F.explode(F.sequence("first", "last")))
    found = named.join(numbers, ["component", "number"]).drop("_id", "_low", "_high", "id", "first", "last", "number")
    return components.join(found, ["component", "version"])


def worst_scores(components: DataFrame, advisories: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """``component, score``: the highest score of an advisory that holds any version of the component; no pairs are made."""
    ranged = _ranged(_live(advisories, ignore))
    _, stretch = _hits(components, ranged)
    return ranged.join(stretch, ranged["_id"] == stretch["id"], "left_semi").groupBy("component").agg(F.max("score").alias("score"))


def dirty_versions(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """``component, version, key`` of the distinct versions inside some range, and ``open``, how many ranges hold it (0 for a clean one)."""
    ranges = _ranged(advisories).select("component", F.col("_id").alias("id"), F.col("_low").alias("low"), F.col("_high").alias("high"))
    swept = _sweep(_keyed(components), ranges).where(F.col("kind") == _VERSION)
    return swept.select("component", "version", "key", "open")


def recommend_upgrades(installed: DataFrame, available: DataFrame, advisories: DataFrame) -> DataFrame:
    """Lowest clean version above the installed one, per affected installed version; null where there is none."""
    everything = installed.select("component", "version", F.lit(True).alias("mine"), F.lit(False).alias("offered"))
    everything = everything.unionByName(available.select("component", "version", F.lit(False).alias("mine"), F.lit(True).alias("offered")))
    roles = everything.groupBy("component", "version").agg(F.max("mine").alias("mine"), F.max("offered").alias("offered"))
    judged = cut_lineage(dirty_versions(everything, advisories).join(roles, ["component", "version"]))
    clean, bad = F.col("offered") & (F.col("open") == 0), F.col("mine") & (F.col("open") > 0)
    # clean versions up to and with the order of the row; spellings of one version are next to each other
    rows = judged.where(clean | bad).withColumns({"rank": F.when(clean, 0).otherwise(1), "one": clean.cast("bigint")})
    counted = cut_lineage(ordered_window(rows, ["component"], ["key", "rank", "version"], _major("key"), running={"upto": ("sum", F.col("one"))}))
    offers = counted.where("rank = 0").select("component", F.col("version").alias("upgrade"), F.col("upto").alias("number"))
    wanted = counted.where("rank = 1").select("component", "version", (F.col("upto") + 1).alias("number"))
    return wanted.join(offers, ["component", "number"], "left").select("component", "version", "upgrade")
