"""Sensitive data: discovery, masking, encryption, audit and access analysis."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.operators.aggs import analytics
from opsloom.operators.joins import compare_tables
from opsloom.operators.logs import template
from opsloom.plans.ordered import ordered_window
from opsloom.plans.predicates import to_column
from opsloom.plans.storage import cut_lineage
from opsloom.plans.timing import bucket

# fixed values: sensitive types with the pattern a value must contain and the column names that suggest them
SENSITIVE = {
    "EMAIL": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "mail"),
    "IP": ("[0-9]{1,3}([.][0-9]{1,3}){3}", "(^|_)ip($|_)"),
    "CARD": ("[0-9]{16}", "card"),
    "PHONE": ("[+][0-9]{1,3} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}", "phone|mobile"),
    "PERSON_NAME": ("^[A-Z][a-z]+#[0-9]+$", "name"),
}


def discover(df: DataFrame, types: dict[str, tuple[str, str]] = SENSITIVE, sample: float | None = None) -> DataFrame:
    """Share of non-null values that match each type, per string column, plus a hit on the column name.

    One pass over all string columns; ``sample`` reads only that fraction.
    """
    if sample:
        df = df.sample(sample, seed=7)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.lit(name).alias("type"), F.count(c).alias("n"),
            F.count_if(F.col(c).rlike(pattern)).alias("hits"), F.lit(re.search(hint, c) is not None).alias("name_hit"),
        ).alias(f"{c}_{name}")
        for c in texts
        for name, (pattern, hint) in types.items()
    ]
    wide = df.agg(*cells)
    long = wide.select(F.explode(F.array(*[F.col(f"`{c}`") for c in wide.columns])).alias("r")).select("r.*")
    return long.withColumn("share", F.round(F.try_divide("hits", "n"), 6)).where("hits > 0 OR name_hit")


def discovery_summary(found: DataFrame) -> DataFrame:
    """Findings per type, per column and in total."""
    aggs = {"columns": "count(DISTINCT column)", "hits": "sum(hits)", "named": "count_if(name_hit)"}
    return analytics(found, ["type", "column"], aggs, [["type"], ["column"], []])


# ---- masking formats: each takes the column and the row key and returns the masked column
Format = Callable[[Column, Column], Column]


def fixed(value) -> Format:
    return lambda col, key: F.lit(value)


def null_out() -> Format:
    return lambda col, key: F.lit(None)


def preserve() -> Format:
    return lambda col, key: col


def hash_number(seed: str, key: Column, n: int) -> Column:
    """A reproducible number in [0, n) from md5 of seed and key; n at most 2^60.

    Eight hex digits serve up to 2^32, fifteen beyond, so that the whole range is reached.
    """
    if n > 1 << 60:
        raise ValueError(f"{n} is more than 2^60")
    digest = F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8 if n <= 1 << 32 else 15), 16, 10).cast("bigint"), F.lit(n))


def hash_text(seed: str, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary"))


def random_number(seed: str, low: int, high: int) -> Format:
    return lambda col, key: hash_number(seed, key, high - low + 1) + low


def random_decimal(seed: str, low: int, high: int, scale: int) -> Format:
    return lambda col, key: (hash_number(seed, key, (high - low) * 10**scale) + low * 10**scale) / F.lit(float(10**scale))


def random_digits(seed: str, n: int) -> Format:
    return lambda col, key: F.lpad(hash_number(seed, key, 10**n).cast("string"), n, "0")


def random_string(seed: str, n: int) -> Format:
    return lambda col, key: F.substring(F.translate(hash_text(seed, key), "0123456789abcdef", "ghijklmnopqrstuv"), 1, n)


def random_date(seed: str, start: str, days: int) -> Format:
    return lambda col, key: F.date_add(F.lit(start).cast("date"), hash_number(seed, key, days).cast("int"))


def random_list(seed: str, values: list[str]) -> Format:
    return lambda col, key: F.element_at(F.array(*[F.lit(v) for v in values]), (hash_number(seed, key, len(values)) + 1).cast("int"))


def keyed_hash(seed: str) -> Format:
    """Same input, same output in every table: keeps joins between masked keys; null stays null."""
    return lambda col, key: F.when(col.isNotNull(), hash_text(seed, col))


def keep_substring(start: int, n: int) -> Format:
    return lambda col, key: F.substring(col, start, n)


def replace_pattern(pattern: str, to: str) -> Format:
    return lambda col, key: F.regexp_replace(col, pattern, to)


def character_pattern(upper: str = "X", lower: str = "x", digit: str = "n") -> Format:
    return lambda col, key: F.mask(col, F.lit(upper), F.lit(lower), F.lit(digit))


def sql_expression(expr: str) -> Format:
    return lambda col, key: F.expr(expr)


def user_function(udf) -> Format:
    """A pandas (Arrow) user function over the column."""
    return lambda col, key: udf(col)


def chained(*steps: Format) -> Format:
    """Each step masks the output of the step before."""
    return lambda col, key: reduce(lambda value, step: step(value, key), steps, col)


def mask(df: DataFrame, key: str, formats: dict[str, Format | list[tuple[object, Format]]]) -> DataFrame:
    """Mask columns; a list gives (condition, format) pairs in order, and a row that meets none keeps its value."""
    out = {}
    for c, spec in formats.items():
        if isinstance(spec, list):
            value = F.col(c)
            for cond, fmt in reversed(spec):
                value = F.when(to_column(cond), fmt(F.col(c), F.col(key))).otherwise(value)
        else:
            value = spec(F.col(c), F.col(key))
        out[c] = value
    return df.withColumns(out)


def mask_with_library(df: DataFrame, key: str, library: dict[str, Format], policy: dict[str, list[tuple[object, str]]]) -> DataFrame:
    """Like mask, with formats taken by name from a shared library."""
    return mask(df, key, {c: [(cond, library[name]) for cond, name in rules] for c, rules in policy.items()})


def delete_rows(df: DataFrame, cond) -> DataFrame:
    """Drop the rows that meet the condition; a null condition keeps the row."""
    return df.where(~F.coalesce(to_column(cond), F.lit(False)))


def truncate(df: DataFrame) -> DataFrame:
    return df.limit(0)


def substitute(df: DataFrame, key: str, col: str, table: DataFrame, index: str, value: str, size: int, seed: str) -> DataFrame:
    """Replace a column by the table row whose index (0 .. size-1) the key hashes to."""
    pick = table.select(F.col(index).cast("bigint").alias("_slot"), F.col(value).alias("_new"))
    rows = df.withColumn("_slot", hash_number(seed, F.col(key), size))
    return rows.join(pick, "_slot", "left").withColumn(col, F.col("_new")).select(*df.columns)


def shuffle(df: DataFrame, key: str, col: str, seed: str, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Permute a column, optionally inside groups; the multiset of values is kept.

    Rows are numbered twice, in two hash orders; number i of the first order
    gets the value of number i of the second.  The numbering runs in blocks of
    equal hash prefix, so neither the table nor a group is one task: 16^``digits``
    blocks, to be chosen so that one of them fits a task.
    """
    by = by or []

    def numbered(side: DataFrame, label: str) -> DataFrame:
        side = side.withColumn("_h", hash_text(f"{seed}-{label}", F.col(key)))
        return ordered_window(side, by, ["_h", key], F.substring("_h", 1, digits), number="_pos").drop("_h")

    rows = numbered(df, "rows")
    values = numbered(df.select(*by, key, F.col(col).alias("_new")), "values").drop(key)
    values = values.withColumnsRenamed({b: f"_b_{b}" for b in by})
    cond = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by], rows["_pos"] == values["_pos"])
    return rows.join(values, cond).withColumn(col, F.col("_new")).select(*df.columns)


@dataclass(frozen=True)
class Relation:
    parent: str
    parent_key: str
    child: str
    child_key: str


def mask_all(
    tables: dict[str, DataFrame], keys: dict[str, str], policy: dict[str, dict[str, Format]], relations: list[Relation]
) -> dict[str, DataFrame]:
    """Mask related tables; a masked parent key is masked the same way in its children.

    Key columns must use a format that depends on the value alone (keyed_hash).
    """
    policy = {t: dict(cols) for t, cols in policy.items()}
    for r in relations:
        if r.parent_key in policy.get(r.parent, {}):
            policy.setdefault(r.child, {})[r.child_key] = policy[r.parent][r.parent_key]
    return {name: mask(df, keys[name], policy.get(name, {})) for name, df in tables.items()}


def masking_report(before: DataFrame, after: DataFrame, key: str, policy: list[str], sensitive: list[str]) -> DataFrame:
    """Per column: rows, changed values, values turned null, and policy against the sensitive model."""
    cols = [c for c in before.columns if c != key]
    pairs = before.select(key, F.struct(*cols).alias("_a")).join(after.select(key, F.struct(*cols).alias("_b")), key)
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias("changed"),
            F.count_if(F.col(f"_a.{c}").isNotNull() & F.col(f"_b.{c}").isNull()).alias("nulled"),
        ).alias(c)
        for c in cols
    ]
    long = pairs.agg(*cells).select(F.explode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("r")).select("r.*")
    in_policy, in_model = F.col("column").isin(policy), F.col("column").isin(sensitive)
    health = (
        F.when(in_model & ~in_policy, "NOT_MASKED").when(in_policy & ~in_model, "NOT_IN_MODEL")
        .when(in_policy & (F.col("changed") == 0), "NO_EFFECT").otherwise("OK")
    )
    return long.withColumn("health", health)


# fixed values: AES-256 in GCM mode, 12 byte initialisation vector, 16 byte tag
ALGORITHM = "AES_256_GCM_IV12_TAG16"
IV_BYTES, TAG_BYTES, KEY_BYTES = 12, 16, 32


def _key_column(df: DataFrame, key: bytes) -> Column:
    """The key as a scalar subquery over a one-row frame, so that it is not a literal of the plan."""
    if len(key) != KEY_BYTES:
        raise ValueError(f"the key must have {KEY_BYTES} bytes")
    spark = df.sparkSession
    return spark.createDataFrame([(bytearray(key),)], "k binary").select("k").scalar()


def encrypt(df: DataFrame, cols: list[str], key: bytes, key_id: str, aad: str = "") -> DataFrame:
    """Each column becomes a struct of header (algorithm, key id, iv, aad) and payload (cipher text and tag)."""
    secret = _key_column(df, key)
    raw = {c: F.aes_encrypt(F.col(c).cast("string").cast("binary"), secret, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad)) for c in cols}
    staged = df.withColumns({f"_enc_{c}": e for c, e in raw.items()})
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(F.col(c))
            continue
        e = F.col(f"_enc_{c}")
        header = F.struct(
            F.lit(ALGORITHM).alias("algorithm"), F.lit(key_id).alias("key_id"), F.substring(e, 1, IV_BYTES).alias("iv"), F.lit(aad).alias("aad")
        )
        payload = F.expr(f"substring(`_enc_{c}`, {IV_BYTES + 1})")
        out.append(F.when(e.isNotNull(), F.struct(header.alias("header"), payload.alias("payload"))).alias(c))
    return staged.select(*out)


def decrypt(df: DataFrame, cols: list[str], key: bytes) -> DataFrame:
    secret = _key_column(df, key)
    plain = {
        c: F.aes_decrypt(F.concat(F.col(f"{c}.header.iv"), F.col(f"{c}.payload")), secret, F.lit("GCM"), F.lit("DEFAULT"), F.col(f"{c}.header.aad")).cast("string")
        for c in cols
    }
    return df.withColumns(plain)


def digest(df: DataFrame, cols: list[str], out: str = "digest") -> DataFrame:
    """MD5 per row over the columns, each with its length, so that no two rows of different values share a text; null and empty text differ."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in cols]
    return df.withColumn(out, F.md5(F.concat_ws("|", *parts).cast("binary")))


def audit_summary(df: DataFrame, dims: list[str], ts: str, period: str) -> DataFrame:
    """Audit events per period, per period and dimension, and in total."""
    rows = df.withColumn("period", bucket(ts, period))
    sets = [["period"], *[["period", d] for d in dims], []]
    return analytics(rows, ["period", *dims], {"events": "count(*)"}, sets)


def state_diff(df: DataFrame, by: list[str], order: list[str], state: str, chunk: Column) -> DataFrame:
    """Keys added, removed and changed between one JSON state and the one before it."""
    rows = ordered_window(df, by, order, chunk, lag={"_old": state})
    new, old = F.from_json(state, "map<string,string>"), F.from_json("_old", "map<string,string>")
    rows = rows.where(F.col("_old").isNotNull()).withColumns({"_n": new, "_o": old})
    names = lambda keys: F.array_join(F.array_sort(keys), ",")
    both = F.array_intersect(F.map_keys("_n"), F.map_keys("_o"))
    return rows.withColumns(
        {
            "added": names(F.array_except(F.map_keys("_n"), F.map_keys("_o"))),
            "removed": names(F.array_except(F.map_keys("_o"), F.map_keys("_n"))),
            "changed": names(F.filter(both, lambda k: ~F.element_at("_n", k).eqNullSafe(F.element_at("_o", k)))),
        }
    ).drop("_n", "_o", "_old")


def baseline_diff(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Findings new, fixed or changed against the baseline."""
    names = F.create_map(*[F.lit(x) for x in ("only_left", "new", "only_right", "fixed", "changed", "changed")])
    return compare_tables(current, baseline, keys).withColumn("status", names[F.col("status")])


def grant_paths(grants: DataFrame, users: DataFrame, privilege: str, max_depth: int | None = None) -> DataFrame:
    """Chains user > role > ... > privilege, of any length unless the caller names a depth.

    ``grants`` is (grantee, granted), ``users`` is (user).  The search runs
    backwards from the privilege, so unrelated users are never visited; a chain
    that would repeat a name is dropped.
    """
    links = cut_lineage(grants.select("grantee", "granted").distinct())
    frontier = links.where(F.col("granted") == privilege).select(
        F.col("grantee").alias("head"), F.array("grantee", "granted").alias("path")
    )
    found = frontier
    for _ in itertools.count() if max_depth is None else range(2, max_depth + 1):
        frontier = (
            frontier.join(links, frontier["head"] == links["granted"])
            .where(~F.array_contains("path", F.col("grantee")))
            .select(F.col("grantee").alias("head"), F.concat(F.array("grantee"), "path").alias("path"))
        )
        frontier = cut_lineage(frontier)
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    hits = found.join(users, found["head"] == users["user"], "left_semi")
    return hits.select(F.col("head").alias("user"), F.array_join("path", " > ").alias("chain"), (F.size("path") - 1).alias("steps"))


def violations(log: DataFrame, allowed: DataFrame, text: str) -> DataFrame:
    """Statements whose normalised form is not on the allowed list, with count and an example."""
    seen = log.select(template(F.col(text)).alias("statement"), F.col(text).alias("_raw"))
    seen = seen.groupBy("statement").agg(F.count("*").alias("n"), F.min("_raw").alias("example"))
    good = allowed.select(template(F.col(text)).alias("statement")).distinct()
    return seen.join(good, "statement", "left_anti")


def user_profile(users: DataFrame, grants: DataFrame, logins: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Risk score per user from granted roles, failed logins and days since the last login.

    ``users`` (user), ``grants`` (user, role), ``logins`` (user, day_age, failed).
    """
    roles = grants.groupBy("user").agg(F.count_distinct("role").alias("roles"))
    seen = logins.groupBy("user").agg(
        F.count("*").alias("logins"), F.count_if("failed").alias("failures"), F.min("day_age").alias("idle_days")
    )
    rows = users.join(roles, "user", "left").join(seen, "user", "left").fillna(0, ["roles", "logins", "failures"])
    score = (
        F.when(F.col("roles") > limits["roles"], 2).otherwise(0)
        + F.when(F.col("failures") > limits["failures"], 2).otherwise(0)
        + F.when(F.col("idle_days").isNull() | (F.col("idle_days") > limits["idle"]), 1).otherwise(0)
    )
    return rows.withColumn("score", score).withColumn("risk", F.when(score >= 4, "HIGH").when(score >= 2, "MEDIUM").otherwise("LOW"))
