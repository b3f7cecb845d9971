"""Run registered queries beside their DuckDB oracles: python -m tests.oracle [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("CHECK_SF", "/root/testdata/sf0.01")


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    return [names[i] for i in order], rows, {names[i]: str(cur.description[i][1]) for i in order}


def compare(spark, con, name):
    """Empty string when equal, else what differs."""
    df = entry.queries()[name](spark, SF)
    cols, got = spark_rows(df)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    want_cols, want, _ = duck_rows(con, sql)
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
        return f"{len(bad)} rows differ, e.g. {diff[:5]} in {a[:6]}"
    return "" if got else "no rows"


def kinds(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ""
    spark_types = dict(df.dtypes)
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}
    _, _, duck_types = duck_rows(con, f"SELECT * FROM ({sql}) LIMIT 0")
    return {c: (t, duck_types[c]) for c, t in spark_types.items() if c in duck_types and pairs.get(t, t) != duck_types[c]}


def main():
    from tidemark.session import local_session

    spark = local_session()
    con = duck()
    names = sys.argv[1:] or list(entry.queries())
    failed = []
    for n in names:
        t = time.time()
        try:
            out = compare(spark, con, n)
            k = kinds(spark, con, n) if not out else ""
        except Exception as e:  # noqa: BLE001
            out, k = f"{type(e).__name__}: {str(e)[:1500]}", ""
        print(f"{'ok ' if not out else 'BAD'} {n} {time.time() - t:.1f}s {out} {k or ''}", flush=True)
        if out:
            failed.append(n)
    print("failed:", failed)


if __name__ == "__main__":
    main()
