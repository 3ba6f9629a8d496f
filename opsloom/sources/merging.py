"""Keyed merges, patches and change feeds applied to a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_per_key(source: DataFrame, keys: list[str]) -> DataFrame:
    """The source as (keys, _src); a key that comes twice fails the job."""
    twice = F.raise_error(F.lit("the source has a key twice")).cast("boolean")
    grouped = source.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*source.columns)).alias("_src"))
    return grouped.where(F.when(F.col("_n") > 1, twice).otherwise(True)).drop("_n")


def _on(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys])


def _unmatched(patch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Patch rows whose key is not in the target.

    The keys that do match are found by a semi join from the target side, so a
    small patch is sent to the target and the target is not shuffled.
    """
    hit = target.select(*keys).join(patch.select(*keys), keys, "left_semi").distinct()
    return patch.join(hit, keys, "left_anti")


def merge_into(
    target: DataFrame, source: DataFrame, keys: list[str], when_matched: str = "update", when_not: str = "insert",
    present: str | None = None,
) -> DataFrame:
    """The target after a keyed merge; keys are unique in both and not null.

    ``present`` names an array column of the source with the fields that are
    set: a field not listed keeps its value, a listed null clears it.  Without
    it every source column counts as set.  when_matched: update, delete or
    ignore; when_not: insert or ignore.
    """
    values = [c for c in target.columns if c not in keys]
    patch = _one_per_key(source, keys)
    out = target
    if when_matched != "ignore":
        joined = target.alias("t").join(patch.alias("p"), _on("t", "p", keys), "left")
        matched = F.col("p._src").isNotNull()
        if when_matched == "delete":
            out = joined.where(~matched).select("t.*")
        else:
            cols = []
            for c in values:
                if c not in source.columns:
                    cols.append(F.col(f"t.{c}"))
                    continue
                use = matched if present is None else matched & F.array_contains(F.col(f"p._src.{present}"), c)
                cols.append(F.when(use, F.col(f"p._src.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
            out = joined.select(*[F.col(f"t.{k}") for k in keys], *cols).select(*target.columns)
    if when_not == "insert":
        fresh = _unmatched(patch, target, keys)
        kinds = {f.name: f.dataType for f in target.schema.fields}
        cols = [F.col(f"_src.{c}").cast(kinds[c]).alias(c) if c in source.columns else F.lit(None).cast(kinds[c]).alias(c) for c in target.columns]
        out = out.unionByName(fresh.select(*cols))
    return out


def apply_patch(df: DataFrame, patch: DataFrame, keys: list[str], seq: str = "seq", op: str = "operation") -> DataFrame:
    """INSERT, REMOVE and MERGE entries applied in order.

    INSERT sets all fields, MERGE those that are not null (and creates a missing
    row), REMOVE drops the row and ignores a missing one.  Per key the entries
    collapse in one aggregation: the last entry that touches a field decides it.
    """
    values = [c for c in df.columns if c not in keys]
    wrapped = {
        f"_{c}": F.when(F.col(op) == "INSERT", F.struct(F.col(c).alias("v")))
        .when(F.col(op) == "REMOVE", F.struct(F.lit(None).cast(df.schema[c].dataType).alias("v")))
        .when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v")))
        for c in values
    }
    rows = patch.withColumns(wrapped)
    last = rows.groupBy(*keys).agg(
        F.max_by(op, seq).alias("_op"),
        *[F.max_by(f"_{c}", F.when(F.col(f"_{c}").isNotNull(), F.col(seq))).alias(f"_{c}") for c in values],
    )
    return _settle(df, last, keys, values, F.col("p._op") == "REMOVE")


def _settle(df: DataFrame, last: DataFrame, keys: list[str], values: list[str], gone: Column) -> DataFrame:
    """Target rows with the collapsed entry of their key, plus rows for new keys; a wrapper that is null keeps the old value."""
    joined = df.alias("t").join(last.alias("p"), _on("t", "p", keys), "left")
    kept = joined.where(~F.coalesce(gone, F.lit(False)))
    cols = [F.when(F.col(f"p._{c}").isNotNull(), F.col(f"p._{c}.v")).otherwise(F.col(f"t.{c}")).alias(c) for c in values]
    old = kept.select(*[F.col(f"t.{k}") for k in keys], *cols)
    new = _unmatched(last, df, keys).alias("p").where(~gone)
    return old.unionByName(new.select(*[F.col(f"p.{k}") for k in keys], *[F.col(f"p._{c}.v").alias(c) for c in values])).select(*df.columns)


def removal_order(patch: DataFrame, path: str) -> DataFrame:
    """Removed paths, deepest first, so that no item goes before its descendants."""
    depth = F.size(F.split(F.col(path), "/"))
    return patch.where("operation = 'REMOVE'").select(path, depth.alias("depth")).orderBy(F.col("depth").desc(), path)


def apply_changes(snapshot: DataFrame, changes: DataFrame, keys: list[str], seq: str, op: str, delete: str = "D") -> DataFrame:
    """A snapshot after a change feed: the latest change per key wins, a delete drops the key.

    ``max_by`` keeps one change per key on the map side already.
    """
    values = [c for c in snapshot.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(op, *values), seq).alias("_last"))
    last = last.select(*keys, F.col(f"_last.{op}").alias("_op"), *[F.struct(F.col(f"_last.{c}").alias("v")).alias(f"_{c}") for c in values])
    return _settle(snapshot, last, keys, values, F.col("p._op") == delete)
