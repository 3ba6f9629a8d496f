"""Projection, filters, column rules, extraction and unit conversion."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.plans.predicates import AllOf, AnyOf, Cond, Negate, all_of, first_match, to_column


def project(df: DataFrame, exprs: list[str | Column]) -> DataFrame:
    return df.select(*[F.expr(e) if isinstance(e, str) else e for e in exprs])


def where(df: DataFrame, cond) -> DataFrame:
    return df.filter(to_column(cond))


def search_condition(tree, cols: list[str]) -> Column:
    """Term tree over text columns: a leaf string must occur in at least one column, in any case."""
    if isinstance(tree, str):
        term = F.lit(tree.lower())
        return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(term), F.lit(False)) for c in cols])
    if isinstance(tree, AllOf):
        return reduce(lambda a, b: a & b, [search_condition(p, cols) for p in tree.parts])
    if isinstance(tree, AnyOf):
        return reduce(lambda a, b: a | b, [search_condition(p, cols) for p in tree.parts])
    if isinstance(tree, Negate):
        return ~search_condition(tree.part, cols)
    raise TypeError(f"not a search term: {tree!r}")


def search(df: DataFrame, tree, cols: list[str] | None = None) -> DataFrame:
    """Rows whose text columns satisfy a tree of terms built with all_of, any_of and Negate."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.filter(search_condition(tree, cols))


def structured_search(
    df: DataFrame, conditions: list[Cond], fields: list[str], order: list[tuple[str, str]] | None = None
) -> DataFrame:
    """All conditions must hold; only declared fields may be named in conditions or order."""
    out = df.filter(to_column(all_of(*conditions), fields))
    if order:
        for name, _ in order:
            if name not in fields:
                raise ValueError(f"unknown field {name!r}")
        out = out.orderBy(*[F.col(n).desc() if d == "desc" else F.col(n).asc() for n, d in order])
    return out


def eval_(df: DataFrame, name: str, expr: str | Column) -> DataFrame:
    return df.withColumn(name, F.expr(expr) if isinstance(expr, str) else expr)


def fields(df: DataFrame, add: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Keep the added columns (all when none is named) without the dropped ones."""
    keep = [c for c in (add or df.columns) if c not in set(drop or [])]
    return df.select(*keep)


def rename(df: DataFrame, mapping: dict[str, str] | None = None, pattern: str | None = None, to: str = "") -> DataFrame:
    """Rename by map, or every column by a regular expression."""
    names = dict(mapping or {})
    if pattern is not None:
        names.update({c: re.sub(pattern, to, c) for c in df.columns if c not in names})
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing}")
    return df.withColumnsRenamed(names)


def matching_columns(
    df: DataFrame, names: list[str] | None = None, pattern: str | None = None, types: list[str] | None = None
) -> list[str]:
    """Columns in the name list, or matching the whole pattern, or of one of the types."""
    hit = []
    for f in df.schema.fields:
        by_name = names is not None and f.name in names
        by_pattern = pattern is not None and re.fullmatch(pattern, f.name) is not None
        by_type = types is not None and f.dataType.simpleString() in types
        if by_name or by_pattern or by_type:
            hit.append(f.name)
    return hit


def columns_where(df: DataFrame, names=None, pattern=None, types=None, mode: str = "include") -> DataFrame:
    hit = matching_columns(df, names, pattern, types)
    return df.select(*hit) if mode == "include" else df.drop(*hit)


def macro(df: DataFrame, columns: list[str], expr: str, out: str) -> DataFrame:
    """The same expression for every column; ``%MACRO%`` stands for the column name."""
    mark = "%MACRO%"
    return df.withColumns({out.replace(mark, c): F.expr(expr.replace(mark, f"`{c}`")) for c in columns})


def map_fields(
    df: DataFrame,
    target: T.StructType,
    direct: dict[str, str] | None = None,
    rules: list[tuple[str, str]] | None = None,
    composite: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Fill a target schema from a source.

    Order of trial per target field: composite (first non-empty source), direct,
    regex rule (source pattern, target name), same name.  Unmapped fields are null.
    """
    by_rule: dict[str, str] = {}
    for pattern, name in rules or []:
        for c in df.columns:
            if re.fullmatch(pattern, c):
                by_rule.setdefault(re.sub(pattern, name, c), c)
    out = []
    for f in target.fields:
        if composite and f.name in composite:
            parts = [F.when(F.col(c).cast("string") != "", F.col(c)) for c in composite[f.name]]
            col = F.coalesce(*parts)
        elif direct and f.name in direct:
            col = F.col(direct[f.name])
        elif f.name in by_rule:
            col = F.col(by_rule[f.name])
        elif f.name in df.columns:
            col = F.col(f.name)
        else:
            col = F.lit(None)
        out.append(col.cast(f.dataType).alias(f.name))
    return df.select(*out)


def flatten(df: DataFrame, col: str, keep_empty: bool = True, sep: str = "_") -> DataFrame:
    """Array column to one row per element, struct column to one column per field."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.ArrayType):
        explode = F.explode_outer if keep_empty else F.explode
        df = df.withColumn(col, explode(col))
        kind = kind.elementType
    if isinstance(kind, T.StructType):
        others = [c for c in df.columns if c != col]
        return df.select(*others, *[F.col(col)[f.name].alias(f"{col}{sep}{f.name}") for f in kind.fields])
    return df


def split(df: DataFrame, routes: dict[str, object], mode: str = "first", default: str = "other") -> dict[str, DataFrame]:
    """Named outputs; ``first`` sends a row to its first matching route, ``all`` to every one."""
    if mode == "first":
        tag = route_tag(routes, default)
        return {n: df.filter(tag == n) for n in [*routes, default]}
    conds = {n: F.coalesce(to_column(c), F.lit(False)) for n, c in routes.items()}
    none = reduce(lambda a, b: a & b, [~c for c in conds.values()])
    return {**{n: df.filter(c) for n, c in conds.items()}, default: df.filter(none)}


def route_tag(routes: dict[str, object], default: str = "other") -> Column:
    return first_match([(c, n) for n, c in routes.items()], default)


def group_names(pattern: str) -> dict[str, int]:
    """Named groups of a Java-style pattern with their numbers."""
    return dict(re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern)).groupindex)


def extract(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """One new column per named group; null where the pattern does not match."""
    hit = F.col(col).rlike(pattern)
    cols = {n: F.when(hit, F.regexp_extract(col, pattern, i)) for n, i in group_names(pattern).items()}
    return df.withColumns(cols)


def regex(df: DataFrame, col: str, pattern: str, negate: bool = False) -> DataFrame:
    cond = F.col(col).rlike(pattern)
    return df.filter(~cond if negate else cond)


def parse_logs(df: DataFrame, col: str, kind: str, spec, error: str = "parse_error") -> DataFrame:
    """Parse raw lines; unmatched lines stay, with null fields and an error text.

    ``kind`` regex: spec is a pattern with named groups; delimited: spec is
    (separator, field names); json: spec maps field names to JSON paths.
    """
    if kind == "regex":
        ok = F.coalesce(F.col(col).rlike(spec), F.lit(False))
        return extract(df, col, spec).withColumn(error, F.when(~ok, F.lit("NO_MATCH")))
    if kind == "delimited":
        sep, names = spec
        parts = F.split(F.col(col), re.escape(sep), -1)
        ok = F.coalesce(F.size(parts) == len(names), F.lit(False))
        cols = {n: F.when(ok, F.get(parts, F.lit(i))) for i, n in enumerate(names)}
        return df.withColumns({**cols, error: F.when(~ok, F.lit("FIELD_COUNT"))})
    if kind == "json":
        cols = {n: F.get_json_object(col, path) for n, path in spec.items()}
        return df.withColumns({**cols, error: F.when(F.get_json_object(col, "$").isNull(), F.lit("BAD_JSON"))})
    raise ValueError(f"unknown parser kind {kind!r}")


HEADER = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}) +\[?([A-Z]+)\]? +(.*)$"


def extract_header(df: DataFrame, col: str) -> DataFrame:
    """Leading timestamp, level and body of a log line; a line without a header is all body."""
    hit = F.coalesce(F.col(col).rlike(HEADER), F.lit(False))
    return df.withColumns(
        {
            "log_time": F.when(hit, F.regexp_extract(col, HEADER, 1).try_cast("timestamp_ntz")),
            "level": F.when(hit, F.regexp_extract(col, HEADER, 2)),
            "body": F.when(hit, F.regexp_extract(col, HEADER, 3)).otherwise(F.col(col)),
        }
    )


def extended_fields(df: DataFrame, rules: list[tuple[object, str, str]]) -> DataFrame:
    """(condition, source column, pattern with named groups): only rows meeting the condition are parsed."""
    for cond, col, pattern in rules:
        ok = to_column(cond) & F.col(col).rlike(pattern)
        df = df.withColumns({n: F.when(ok, F.regexp_extract(col, pattern, i)) for n, i in group_names(pattern).items()})
    return df


def json_project(df: DataFrame, col: str, paths: dict[str, str]) -> DataFrame:
    return df.withColumns({n: F.get_json_object(col, p) for n, p in paths.items()})


def coerce_enum(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """Values outside the known set become the fixed value UNKNOWN_ENUM_VALUE; null stays null."""
    known = F.col(col).isNull() | F.col(col).isin(allowed)
    return df.withColumn(col, F.when(known, F.col(col)).otherwise("UNKNOWN_ENUM_VALUE"))


OFFSET = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def to_utc(df: DataFrame, col: str, tz: str | None = None, out: str | None = None) -> DataFrame:
    """UTC wall time: a naive value is read as UTC (or as ``tz``), an offset in the text is kept."""
    kind = df.schema[col].dataType
    zone = F.lit(tz or "UTC")
    if isinstance(kind, T.StringType):
        instant = F.try_to_timestamp(col)
        aware = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
        naive = F.convert_timezone(zone, F.lit("UTC"), F.col(col).try_cast("timestamp_ntz"))
        value = F.when(F.col(col).rlike(OFFSET), aware).otherwise(naive)
    elif isinstance(kind, T.TimestampNTZType):
        value = F.convert_timezone(zone, F.lit("UTC"), F.col(col))
    else:
        value = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(col).cast("timestamp_ntz"))
    return df.withColumn(out or col, value)


def snake(col: Column) -> Column:
    """Identifier in lower case with words joined by underscores."""
    words = F.regexp_replace(col, r"([a-z0-9])([A-Z])", "$1_$2")
    words = F.regexp_replace(words, r"[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(words, r"^_+|_+$", ""))


def to_snake(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, snake(F.col(col)))


def run_template(spark: SparkSession, sql: str, params: dict, **views: DataFrame) -> DataFrame:
    """A stored query with typed named parameters; ``{name}`` stands for a DataFrame given by keyword."""
    return spark.sql(sql, args=params, **views)


def data_object_query(
    df: DataFrame,
    columns: list[str],
    conds: list = (),
    group: list[str] = (),
    aggs: dict[str, str] | None = None,
    order: list[str] = (),
    ts: str | None = None,
    start: str | None = None,
    end: str | None = None,
    params: dict | None = None,
) -> DataFrame:
    """Query over a named data set with a time range (end excluded) and bind values.

    A condition value written ``:name`` is replaced from ``params``.
    """
    bound = []
    for c in conds:
        if isinstance(c, Cond) and isinstance(c.value, str) and c.value.startswith(":"):
            if c.value[1:] not in (params or {}):
                raise ValueError(f"no value bound for {c.value}")
            c = Cond(c.field, c.op, params[c.value[1:]])
        bound.append(c)
    out = df.filter(to_column(all_of(*bound)))
    if start:
        out = out.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end:
        out = out.filter(F.col(ts) < F.lit(end).cast(df.schema[ts].dataType))
    if aggs:
        out = out.groupBy(*group).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
    out = out.select(*columns)
    return out.orderBy(*order) if order else out


# fixed values: unit factors to the base unit of each family
UNITS = {
    "size": {"B": 1.0, "KB": 1024.0, "MB": 1024.0**2, "GB": 1024.0**3, "TB": 1024.0**4},
    "rate": {"per_second": 1.0, "per_minute": 1 / 60.0, "per_hour": 1 / 3600.0},
    "time": {"ms": 0.001, "s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0},
}


def convert_units(df: DataFrame, col: str, source: str, target: str, out: str | None = None) -> DataFrame:
    """Size, rate and time by factor; temperature between C, F and K."""
    value = F.col(col)
    for family in UNITS.values():
        if source in family and target in family:
            return df.withColumn(out or col, value * F.lit(family[source]) / F.lit(family[target]))
    to_kelvin = {"C": value + 273.15, "F": (value - 32) * 5 / 9 + 273.15, "K": value}
    if source in to_kelvin and target in to_kelvin:
        k = to_kelvin[source]
        return df.withColumn(out or col, {"C": k - 273.15, "F": (k - 273.15) * 9 / 5 + 32, "K": k}[target])
    raise ValueError(f"cannot convert {source} to {target}")
