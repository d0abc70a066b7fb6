"""Run registered queries beside their SQL: python tests/check_oracles.py SF [name...]"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from caselight.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def compare(df, con, sql: str) -> str:
    """"" if both results agree, else what differs."""
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    theirs = cur.fetchall()
    names = sorted(df.columns)
    if names != sorted(cols):
        return f"columns {names} != {sorted(cols)}"
    ours = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    at = [cols.index(c) for c in names]
    theirs = [tuple(plain(r[i]) for i in at) for r in theirs]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{n}:{t}/{types[n]}" for n, t in df.dtypes if kinds.get(t) != types[n]]
    note = f" (types {odd})" if odd else ""
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}{note}"
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(ours, key=key), sorted(theirs, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {names}\n   {str(bad[0][0])[:600]}\n   {str(bad[0][1])[:600]}{note}"
    return f"types {odd}" if odd else ""


def main() -> int:
    import __spark_entry__ as e

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:] or list(e.queries())
    spark, con, failed = local_session(os.cpu_count()), connect(sf_dir), []
    sqls = e.oracle_sql()
    for name in wanted:
        t = time.time()
        try:
            df = e.queries()[name](spark, sf_dir)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                problem, n = "", df.count()
        except Exception as err:  # report and go on
            problem = f"{type(err).__name__}: {str(err)[:900]}"
        label = "ok  " if not problem else "FAIL"
        rows = "" if name in sqls else " (rows only)"
        print(f"{label} {name}{rows} {time.time() - t:.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
        spark.catalog.clearCache()
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
