"""Mixing sources to target sizes by entropy balancing, in DataFrame functions only.

Each document gets a rate, the number of copies that the mix wants of it.  Among all rates from 0
to ``most`` that meet the target of each source, those of least relative entropy to one copy each
are wanted.  The dual of that problem is convex with one multiplier per source, and its optimum
tilts the rates exponentially: rate = min(most, exp(multiplier * size)).  Newton steps find the
multipliers of all sources at once; each step is one aggregation.  Documents of one source and
size have one rate, so the steps read a table of counts per source and size, a cell each.

Rounding works on the same cells.  The copies of a cell are the difference of the rounded running
sums of rates from the largest size down, which leaves less than half of the largest document over
or under per source; then single copies of the size nearest to what is left come or go.  Which
documents of a cell get the copy more is dealt out over slots by a hash of the id, so neither a
source nor a size nor a text is one window.

Sums of reals are taken in decimals, which have no order of addition, so reruns agree to the row.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.plans.storage import cut_lineage

_WORD = r"[^\x20\x09-\x0D]+"
#: Newton steps at most (a bracket is halved at worst), and rounds that move single copies.
STEPS = 200
MOVES = 8


def _exact_sum(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, key, source, size``: the words of each text, 0 for a null one; the key names the source and is never null."""
    source = docs[source_col].cast("string")
    n = F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(_WORD)), F.lit(0))
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"), source.alias("source"), n.cast("bigint").alias("size"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in ``order``; the ranges of a sort are counted, none is gathered."""
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_at", at).join(counts.select("_range", before.alias("_before")), "_range").select(*rows.columns, (F.col("_before") + F.col("_at") - 1).alias("place"))


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``key, source_size, target``: ``share`` of all sizes split by the repeating ``weights``, no target above ``most`` times its source.

    What a full source cannot take is shared by weight among the others, until none is above.  The
    driver sees three sums a round, and a round fills one source more at least.
    """
    ordered = numbered(sources, F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    table = cut_lineage(ordered.select("key", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("bound")))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    unit, full = 0.0, None
    while True:
        above = F.col("weight") * unit >= F.col("bound")
        now, taken, rest = table.agg(F.count_if(above), _exact_sum(F.when(above, F.col("bound")).otherwise(0.0)), _exact_sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if now == full or not rest:
            break
        full, unit = now, (total - taken) / rest
    return table.select("key", "source_size", F.least(F.col("weight") * unit, F.col("bound")).alias("target"))


def multipliers(cells: DataFrame, wanted: DataFrame, most: float, tolerance: float = 1e-11) -> DataFrame:
    """``key, multiplier`` from ``cells`` (``key, size, n``, sizes above 0) and ``wanted`` (``key, source_size, target``).

    The logarithm of a source's sum of rate times size is brought to that of its target by Newton
    steps; a step that leaves the bracket of the root is replaced by halving it.  Each step writes
    one row per source, and the driver asks only whether a source is still open.
    """
    x, top = F.col("size").cast("double"), log(most)
    reach = cells.groupBy("key").agg(F.min("size").alias("least"))
    # at the lower end no rate is above target / source_size, at the upper end all are at their bound
    low = F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))) / F.col("least")
    high = F.lit(top) / F.col("least")
    full = F.col("target") >= F.col("source_size") * most * (1 - tolerance)
    state = wanted.where("target > 0").join(reach, "key")
    state = cut_lineage(state.select("key", "target", low.alias("low"), high.alias("high"), F.when(full, high).otherwise(0.0).alias("multiplier"), full.alias("done")))
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            break
        tilted = cells.join(state.where("not done").select("key", "multiplier"), "key")
        rate = F.exp(F.least(F.col("multiplier") * x, F.lit(top)))
        bends = F.when(F.col("multiplier") * x < top, F.col("n") * x * x * rate).otherwise(0.0)
        sums = tilted.groupBy("key").agg(_exact_sum(F.col("n") * x * rate).alias("sum"), _exact_sum(bends).alias("slope"))
        over, at = F.col("sum") > F.col("target"), F.col("multiplier")
        state = state.join(sums, "key", "left").withColumns({"low": F.when(over, F.col("low")).otherwise(F.coalesce(F.when(~over, at), F.col("low"))), "high": F.coalesce(F.when(over, at), F.col("high"))})
        newton = at + F.log(F.col("target") / F.col("sum")) * F.col("sum") / F.col("slope")
        step = F.when((F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high")), newton).otherwise((F.col("low") + F.col("high")) / 2)
        met = (F.abs(F.col("sum") - F.col("target")) <= tolerance * F.col("target")) | (step == at)
        state = cut_lineage(state.select("key", "target", "low", "high", F.when(F.col("done") | met, at).otherwise(step).alias("multiplier"), (F.col("done") | met).alias("done")))
    return state.select("key", "multiplier")


def rounded(cells: DataFrame, most: int) -> DataFrame:
    """``cells`` (``key, size, n, target, rate``) with ``copies`` of each cell in place of the rate.

    No cell gets more than ``most`` copies of each of its documents, or fewer than none.
    """
    down = Window.partitionBy("key").orderBy(F.col("size").desc())
    running = F.round(F.sum((F.col("n") * F.col("rate")).cast("decimal(38,12)")).over(down)).cast("bigint")
    marked = cells.withColumn("_running", running)
    copies = F.col("_running") - F.lag("_running", 1, 0).over(down)
    room = F.col("n") * most
    cells = cut_lineage(marked.select("key", "size", "n", "target", F.greatest(F.lit(0), F.least(copies, room)).alias("copies")))
    for _ in range(MOVES):
        left = cells.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        ways = cells.join(left, "key")
        after = F.abs(F.abs("left") - F.col("size"))
        free = F.when(F.col("left") > 0, F.col("copies") < room).otherwise(F.col("copies") > 0)
        ways = ways.where(free & (F.col("size") > 0) & (after < F.abs("left")))
        step = ways.groupBy("key").agg(F.min_by(F.struct("size", F.signum("left").cast("bigint").alias("one")), F.struct(after, "size")).alias("step"))
        step = cut_lineage(step.select("key", "step.size", "step.one"))
        if step.isEmpty():
            break
        cells = cut_lineage(cells.join(step, ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("one", F.lit(0))).drop("one"))
    return cells.drop("target")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies``: how often the mix takes each document.

    The sources, by code point and null last, have the ``weights`` in turn and share ``share`` times
    all words; no document is taken more than ``most`` times, and ``share`` must not be above that.
    A row per row of ``docs``: rows that repeat an id count each; null and empty texts have size 0 and
    are never taken; a null source is one of its own, the empty string another; a null id is an id.
    Texts of any length count whole.  An empty table gives no row; other columns are ignored.
    """
    if not 0 <= share <= most:
        raise ValueError("the share must be from 0 to the number of copies")
    rows = cut_lineage(sizes(docs, id_col, text_col, source_col))
    # the square root of the rows: slots of a size and rows of a slot are then both few
    slots = max(1, ceil(sqrt(rows.count())))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)))
    cells = cut_lineage(rows.groupBy("key", "source", "size").agg(F.count("*").alias("n")))
    wanted = cut_lineage(targets(cells.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    filled = cells.where("size > 0").select("key", "size", "n")
    tilts = multipliers(filled, wanted, float(most))
    rate = F.exp(F.least(F.col("multiplier") * F.col("size"), F.lit(log(most))))
    copies = rounded(filled.join(tilts, "key").join(wanted, "key").select("key", "size", "n", "target", rate.alias("rate")), most)
    decided = cells.join(wanted, "key").join(copies.select("key", "size", "copies"), ["key", "size"], "left")
    every = F.floor(F.coalesce("copies", F.lit(0)) / F.col("n"))
    decided = decided.select("key", "size", "n", "source_size", "target", every.alias("every"), (F.coalesce("copies", F.lit(0)) - every * F.col("n")).alias("extra"))
    # a slot's part of the extra copies, by its rows among those of the cell
    parts = rows.groupBy("key", "size", "slot").agg(F.count("*").alias("here")).join(decided, ["key", "size"])
    upto = F.sum("here").over(Window.partitionBy("key", "size").orderBy("slot"))
    part = lambda count: F.floor(F.col("extra").cast("decimal(19,0)") * count.cast("decimal(19,0)") / F.col("n")).cast("bigint")
    parts = parts.withColumn("_upto", upto).select("key", "size", "slot", "source_size", "target", "every", (part(F.col("_upto")) - part(F.col("_upto") - F.col("here"))).alias("extra"))
    place = F.row_number().over(Window.partitionBy("key", "size", "slot").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id"))
    dealt = rows.withColumn("_place", place).join(parts, ["key", "size", "slot"])
    taken = (F.col("every") + (F.col("_place") <= F.col("extra")).cast("bigint")).cast("bigint")
    return dealt.select("doc_id", "size", "source_size", "target", (taken * F.col("size")).alias("taken"), taken.alias("copies"))
