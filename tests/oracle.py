"""Run queries against their SQL statement in DuckDB and compare schema names and values.

    python tests/oracle.py [--sf DIR] [--slow SECONDS] [name-or-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v if os.environ.get("EXACT") else float(f"{v:.9g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(v):
    return "null" if v is None else type(v).__name__


def compare(con, df, sql):
    """Empty string when equal, otherwise a short account of the difference."""
    order = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in order) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != order:
        return f"columns {order} vs {sorted(names)}"
    ix = [names.index(c) for c in order]
    want = [tuple(norm(r[i]) for i in ix) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if not got:
        return "no rows"
    key = lambda r: tuple((kind(v) if not isinstance(v, (int, float)) else "n", str(v)) for v in r)
    got.sort(key=key), want.sort(key=key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; {order}: {bad[0][0]} vs {bad[0][1]}"
    for i, c in enumerate(order):
        kg = {kind(r[i]) for r in got} - {"null"}
        kw = {kind(r[i]) for r in want} - {"null"}
        if kg != kw:
            return f"type of {c}: {kg} vs {kw}"
    return ""


def main(argv):
    import __spark_entry__ as e
    from zonecraft.session import get_session
    folder = "/root/testdata/sf0.001"
    slow = 3.0
    names = []
    it = iter(argv)
    for a in it:
        if a == "--sf":
            folder = f"/root/testdata/sf{next(it)}"
        elif a == "--slow":
            slow = float(next(it))
        else:
            names.append(a)
    spark = get_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    qs, sqls = e.queries(), e.oracle_sql()
    pick = [q for q in qs if not names or any(q == n or q.startswith(n + "_") or q.startswith(n) and n.endswith("_") for n in names)]
    good = 0
    for q in pick:
        t = time.time()
        try:
            if q in sqls:
                msg = compare(con, qs[q](spark, folder), sqls[q])
            else:
                n = len(qs[q](spark, folder).collect())
                msg = "" if n else "no rows"
        except Exception as ex:  # report every failing query
            msg = f"{type(ex).__name__}: {str(ex)[:700]}"
        dt = time.time() - t
        if msg:
            print(f"FAIL {q} {msg}", flush=True)
        else:
            good += 1
            if dt > slow:
                print(f"slow {q} {dt:.1f}s", flush=True)
    print(f"{good}/{len(pick)} good on {folder}; {len([q for q in pick if q in sqls])} with SQL")
    return good == len(pick)


if __name__ == "__main__":
    sys.exit(0 if main(sys.argv[1:]) else 1)
