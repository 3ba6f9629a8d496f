"""Run registered queries against their SQL twins in DuckDB and compare all values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def twin_connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _order(row):
    return tuple((x is None, type(x).__name__, str(x)) for x in row)


def spark_rows(df):
    names = sorted(df.columns)
    assert len(set(names)) == len(names), f"repeated column names {names}"
    rows = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    return names, sorted(rows, key=_order)


def twin_rows(con, sql):
    cur = con.execute(sql)
    raw = [d[0] for d in cur.description]
    names = sorted(raw)
    at = [raw.index(n) for n in names]
    rows = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
    return names, sorted(rows, key=_order)


def types_of(con, sql):
    return {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}


SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "smallint": "SMALLINT", "float": "FLOAT",
}


def compare(spark, con, name, fn, sql, folder):
    df = fn(spark, folder)
    sn, sr = spark_rows(df)
    if sql is None:
        return f"rows-only {len(sr)}", True
    on, orows = twin_rows(con, sql)
    if sn != on:
        return f"columns {sn} vs {on}", False
    kinds = types_of(con, sql)
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if SAME.get(t) != kinds[f.name]:
            return f"type of {f.name}: {t} vs {kinds[f.name]}", False
    if len(sr) != len(orows):
        return f"rows {len(sr)} vs {len(orows)}", False
    bad = [(a, b) for a, b in zip(sr, orows) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ, first {sn}\n   spark  {str(bad[0][0])[:600]}\n   sql    {str(bad[0][1])[:600]}", False
    return f"ok {len(sr)} rows", bool(sr)


def main():
    from opsloom.catalog import SQL_TWINS, QUERIES
    from opsloom.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    names = [n for n in QUERIES if not wanted or any(n == w or n.startswith(w + "_") or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    spark = local_session()
    con = twin_connection(folder)
    failed = []
    for n in names:
        t = time.time()
        try:
            text, ok = compare(spark, con, n, QUERIES[n], SQL_TWINS.get(n), folder)
        except Exception as e:  # show and go on
            text, ok = f"{type(e).__name__}: {str(e)[:900]}", False
        took = time.time() - t
        if not ok or took > 5 or "-v" in sys.argv:
            print(f"{'ok ' if ok else 'BAD'} {n} {took:.1f}s {text}", flush=True)
        if not ok:
            failed.append(n)
    print(f"{len(names) - len(failed)} of {len(names)} good; failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
