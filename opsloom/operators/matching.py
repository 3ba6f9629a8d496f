"""Lookups by pattern and network through an index of literals.

Entries are keyed by something that a value must hold to match: the longest literal of a pattern,
at the start, at the end or anywhere in it, or the leading bits of a network.  Values offer their
pieces of the lengths in use, so a value meets an entry only if it holds its literal; the pattern
itself is tested on what meets.  Distinct values are matched, not rows, so a value that fills a
third of the table costs as much as any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.plans.storage import cut_lineage

_PREFIX, _SUFFIX, _INSIDE, _NONE = "prefix", "suffix", "inside", "none"


def ip_bits(col: str) -> Column:
    """IPv4 address as 32 binary digits; null when it is not one."""
    parts = F.split(F.col(col), "[.]")
    n = [F.get(parts, F.lit(i)).try_cast("int") for i in range(4)]
    bits = F.concat(*[F.lpad(F.bin(x), 8, "0") for x in n])
    good = reduce(lambda a, b: a & b, [x.between(0, 255) for x in n]) & (F.size(parts) == 4)
    return F.when(good, bits)


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of a pattern, where * is any text and ? any character; it matches whole values."""
    plain = F.regexp_replace(pattern, r"([.\\+^$|(){}\[\]])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(plain, r"\*", ".*"), r"\?", "."), F.lit(r"\z"))


def pattern_key(pattern: Column) -> Column:
    """Under which literal a pattern is entered: ``place`` and ``literal``, the longest one, the ends before the inside.

    A pattern of wildcards alone has place ``none`` and, as literal, how long a value must be and whether it may be longer.
    """
    literals = F.split(pattern, "[*?]")
    count = F.size(literals)
    place = lambda i: F.when(i == 0, 0).when(i == count - 1, 1).otherwise(2)
    pieces = F.transform(literals, lambda x, i: F.struct((-F.length(x)).alias("size"), place(i).alias("rank"), x.alias("literal")))
    best = F.array_min(pieces)
    least, open_end = F.length(F.replace(pattern, F.lit("*"), F.lit(""))), F.contains(pattern, F.lit("*"))
    wild = F.struct(F.lit(_NONE).alias("place"), F.concat(least.cast("string"), F.when(open_end, "+").otherwise("")).alias("literal"))
    names = F.when(best["rank"] == 0, _PREFIX).when(best["rank"] == 1, _SUFFIX).otherwise(_INSIDE)
    return F.when(best["size"] == 0, wild).otherwise(F.struct(names.alias("place"), best["literal"].alias("literal")))


def _offers(value: Column, lengths: dict[str, list]) -> Column:
    """The pieces of a value that can be the literal of an entry, each once."""
    size = F.length(value)
    one = lambda place, piece: F.struct(F.lit(place).alias("place"), piece.alias("literal"))
    none = F.array().cast("array<struct<place:string,literal:string>>")
    parts = [none]
    for n in lengths.get(_PREFIX, []):
        parts.append(F.when(size >= n, F.array(one(_PREFIX, F.substring(value, 1, n)))).otherwise(none))
    for n in lengths.get(_SUFFIX, []):
        parts.append(F.when(size >= n, F.array(one(_SUFFIX, F.right(value, F.lit(n))))).otherwise(none))
    for n in lengths.get(_INSIDE, []):
        places = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
        inside = F.array_distinct(F.transform(places, lambda i: F.substring(value, i, F.lit(n))))
        parts.append(F.when(size >= n, F.transform(inside, lambda piece: one(_INSIDE, piece))).otherwise(none))
    for n in lengths.get(_NONE, []):
        fits = size >= int(n[:-1]) if n.endswith("+") else size == int(n)
        parts.append(F.when(fits, F.array(one(_NONE, F.lit(n)))).otherwise(none))
    return F.concat(*parts)


def _wildcard_hits(values: DataFrame, entries: DataFrame) -> DataFrame:
    """``_value, _order, _hit`` of the patterns that match."""
    keyed = entries.withColumn("_key", pattern_key(F.col("_ref"))).select("_ref", "_order", "_hit", "_key.*")
    # patterns of wildcards alone differ by their length only; the first of each kind is enough
    wild = keyed.where(F.col("place") == _NONE).groupBy("place", "literal").agg(F.min_by(F.struct("_ref", "_order", "_hit"), "_order").alias("e")).select("e.*", "place", "literal")
    keyed = cut_lineage(keyed.where(F.col("place") != _NONE).unionByName(wild))
    # lengths in use: none is longer than the longest pattern
    used = keyed.select("place", F.when(F.col("place") == _NONE, F.col("literal")).otherwise(F.length("literal").cast("string")).alias("n")).distinct().collect()
    lengths: dict[str, list] = {}
    for r in sorted(used, key=lambda r: (r.place, len(r.n), r.n)):
        lengths.setdefault(r.place, []).append(r.n if r.place == _NONE else int(r.n))
    offered = values.select("_value", F.explode(_offers(F.col("_value"), lengths)).alias("_o")).select("_value", "_o.*")
    met = offered.join(keyed, ["place", "literal"])
    return met.where((F.col("place") == _NONE) | F.rlike(F.col("_value"), pattern_regex(F.col("_ref")))).select("_value", "_order", "_hit")


def _network_hits(values: DataFrame, entries: DataFrame) -> DataFrame:
    """The same for networks: equality of the leading bits, for each size in use; a size of 0 holds every address."""
    size = F.substring_index("_ref", "/", -1).try_cast("int")
    nets = entries.withColumns({"_net": F.substring_index("_ref", "/", 1), "_size": size}).where(F.col("_size").between(0, 32))
    nets = nets.withColumn("_bits", F.substring(ip_bits("_net"), F.lit(1), F.col("_size"))).where("_bits IS NOT NULL")
    # networks that differ in host bits only are one
    nets = cut_lineage(nets.groupBy("_size", "_bits").agg(F.min_by("_hit", "_order").alias("_hit"), F.min("_order").alias("_order")))
    sizes = sorted(r[0] for r in nets.select("_size").distinct().collect())
    rows = values.withColumn("_ip", ip_bits("_value")).where("_ip IS NOT NULL")
    offers = F.array(*[F.struct(F.lit(n).alias("_size"), F.substring("_ip", 1, n).alias("_bits")) for n in sizes])
    offers = offers if sizes else F.array().cast("array<struct<_size:int,_bits:string>>")
    return rows.select("_value", F.explode(offers).alias("_o")).select("_value", "_o.*").join(nets, ["_size", "_bits"]).select("_value", "_order", "_hit")


def lookup_match(df: DataFrame, ref: DataFrame, col: str, ref_col: str, kind: str, cols: list[str], order: str) -> DataFrame:
    """``df`` with reference columns of the first matching entry (by ``order``): exact, nocase, wildcard or cidr.

    A row without a match, a null value and a null entry have nulls; entries of equal order are
    taken by their columns.  The entries are read when this is called, as their lengths decide what values offer.
    """
    rank = F.struct(F.col(order).alias("_0"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(cols, 1)))
    entries = ref.where(F.col(ref_col).isNotNull()).select(F.col(ref_col).alias("_ref"), rank.alias("_order"), F.struct(*cols).alias("_hit"))
    entries = entries.groupBy("_ref").agg(F.min_by("_hit", "_order").alias("_hit"), F.min("_order").alias("_order"))
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_value")).distinct()
    if kind == "exact":
        hits = values.join(entries, F.col("_value") == F.col("_ref"))
    elif kind == "nocase":
        hits = values.join(entries, F.lower("_value") == F.lower("_ref"))
    elif kind == "wildcard":
        hits = _wildcard_hits(values, entries)
    elif kind == "cidr":
        hits = _network_hits(values, entries)
    else:
        raise ValueError(f"unknown match kind {kind!r}")
    first = hits.groupBy("_value").agg(F.min_by("_hit", "_order").alias("_hit"))
    out = df.join(first, df[col] == first["_value"], "left")
    return out.select(*(df[c] for c in df.columns), *(first["_hit"][c].alias(c) for c in cols))
