"""Runs queries beside their SQL: python -m tests.oracle [SF_DIR] [NAME...] (prefix* allowed)."""

from __future__ import annotations

import fnmatch
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings changelog vectors hits notes billing_lines doc_labels tenant_usage mix_targets".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def connect(base: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{base}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def compare(spark, c, f, sql: str, base: str) -> str:
    """Empty if the rows and column names agree."""
    df = f(spark, base)
    cols = sorted(df.columns)
    ours = Counter(tuple(plain(r[x]) for x in cols) for r in df.collect())
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    pos = [names.index(x) for x in cols]
    theirs = Counter(tuple(plain(r[i]) for i in pos) for r in cur.fetchall())
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; ours only {list((ours - theirs).items())[:3]}; SQL only {list((theirs - ours).items())[:3]}"
    kinds = {k: t for k, t in df.dtypes}
    want = {n: str(d[1]) for n, d in zip(names, cur.description)}
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN"}
    off = [f"{k}: {kinds[k]} and {want[k]}" for k in cols if kinds[k] in same and want[k] != same[kinds[k]]]
    return f"types {off}" if off else ""


def main() -> None:
    import __spark_entry__ as e
    from memquarry.plans.session import local_session

    base = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or ["*"]
    spark = local_session(8, 8)
    c = connect(base)
    q, s = e.queries(), e.oracle_sql()
    bad = 0
    for k in q:
        if not any(fnmatch.fnmatch(k, n) for n in names):
            continue
        t = time.time()
        try:
            why = compare(spark, c, q[k], s[k], base) if k in s else f"no SQL, {q[k](spark, base).count()} rows"
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:700]}"
        bad += bool(why) and not why.startswith("no SQL")
        print(f"{k}: {why or 'ok'} ({time.time() - t:.1f} s)", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
