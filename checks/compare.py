"""Run cases on both engines and compare rows (a local check; the oracle never runs in the library)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from .registry import CASES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([norm(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def compare(name: str, spark, con, sf_dir: str) -> str:
    c = CASES[name]
    t0 = time.time()
    df = c.spark(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    sql = c.oracle()
    if sql is None:
        return f"ROWS  {name:30s} {len(got):7d} rows  spark {t1 - t0:6.2f}s"
    cur = con.execute(sql)
    want = cur.fetchall()
    t2 = time.time()
    gc, g = rows_of(df.columns, got)
    wc, w = rows_of([d[0] for d in cur.description], want)
    head = f"{name:30s} {len(g):7d}/{len(w):7d} rows  spark {t1 - t0:6.2f}s  sql {t2 - t1:6.2f}s"
    if gc != wc:
        return f"COLS  {head} {gc} {wc}"
    if len(g) != len(w):
        return f"COUNT {head}" + diff(gc, g, w)
    bad = sum(a != b for a, b in zip(g, w))
    return f"OK    {head}" if bad == 0 else f"DIFF  {head} {bad} rows" + diff(gc, g, w)


def diff(cols, g, w) -> str:
    gs, ws = {tuple(map(str, r)) for r in g}, {tuple(map(str, r)) for r in w}
    lines = ["", "    " + ", ".join(cols)]
    lines += ["    spark " + ", ".join(r) for r in sorted(gs - ws)[:4]]
    lines += ["    sql   " + ", ".join(r) for r in sorted(ws - gs)[:4]]
    return "\n".join(lines)


def main(argv: list[str]) -> int:
    from realcurve.session import local_session

    import checks.all  # noqa: F401

    sf_dir, names = argv[0], argv[1:]
    if len(names) == 1 and names[0].startswith("@"):
        names = [n for n, c in CASES.items() if c.build.__module__.endswith(names[0][1:])]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    fails = 0
    for n in names or list(CASES):
        try:
            line = compare(n, spark, con, sf_dir)
        except Exception as e:  # noqa: BLE001
            line = f"ERROR {n} {type(e).__name__}: {str(e)[:900]}"
        fails += not line.startswith(("OK", "ROWS"))
        print(line, flush=True)
    print(f"{fails} not matching")
    return fails


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
