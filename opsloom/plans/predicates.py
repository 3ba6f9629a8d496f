"""Conditions as plain data, compiled to one Column so that filters reach the scan."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)),
    "not in": lambda c, v: ~c.isin(list(v)),
    "between": lambda c, v: c.between(*v),
    "like": lambda c, v: c.like(v),
    "wildcard": lambda c, v: c.rlike(wildcard_regex(v)),
    "matches": lambda c, v: c.rlike(v),
    "contains": lambda c, v: c.contains(v),
    "starts with": lambda c, v: c.startswith(v),
    "is null": lambda c, v: c.isNull(),
    "not null": lambda c, v: c.isNotNull(),
}


@dataclass(frozen=True)
class Cond:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class AllOf:
    parts: tuple


@dataclass(frozen=True)
class AnyOf:
    parts: tuple


@dataclass(frozen=True)
class Negate:
    part: Any


def all_of(*parts) -> AllOf:
    return AllOf(parts)


def any_of(*parts) -> AnyOf:
    return AnyOf(parts)


def wildcard_regex(pattern: str) -> str:
    """``*`` and ``?`` wildcards as an anchored regular expression."""
    body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
    return f"^{body}$"


def to_column(tree, allowed: list[str] | None = None) -> Column:
    """Fold a condition tree to a Column; fields outside ``allowed`` are refused."""
    if isinstance(tree, Column):
        return tree
    if isinstance(tree, str):
        return F.expr(tree)
    if isinstance(tree, Cond):
        if allowed is not None and tree.field not in allowed:
            raise ValueError(f"unknown field {tree.field!r}")
        if tree.op not in OPERATORS:
            raise ValueError(f"unknown operator {tree.op!r}")
        return OPERATORS[tree.op](F.col(tree.field), tree.value)
    if isinstance(tree, AllOf):
        return reduce(lambda a, b: a & b, [to_column(p, allowed) for p in tree.parts], F.lit(True))
    if isinstance(tree, AnyOf):
        return reduce(lambda a, b: a | b, [to_column(p, allowed) for p in tree.parts], F.lit(False))
    if isinstance(tree, Negate):
        return ~to_column(tree.part, allowed)
    raise TypeError(f"not a condition: {tree!r}")


def first_match(rules: list[tuple[Any, Any]], default=None) -> Column:
    """Value of the first rule whose condition holds."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(to_column(cond), value) if out is None else out.when(to_column(cond), value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def all_matches(rules: list[tuple[Any, Any]]) -> Column:
    """Array of the values of every rule whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(to_column(c), v if isinstance(v, Column) else F.lit(v)) for c, v in rules]))
