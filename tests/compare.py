"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_norm(v) for v in r) for r in df.select(*cols).collect())


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())


def main(names, sf_dir):
    import __spark_entry__ as entry
    from corpuscope.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        t0 = time.time()
        try:
            cols, got = rows_of_spark(queries[name](spark, sf_dir))
            t1 = time.time()
            if name not in oracles:
                print(f"rows  {name:28s} {len(got):7d} rows  spark {t1 - t0:6.2f}s", flush=True)
                continue
            ocols, want = rows_of_duck(con, oracles[name])
            t2 = time.time()
            ok = cols == ocols and got == want
            print(f"{'ok   ' if ok else 'DIFF '} {name:28s} {len(got):7d} rows  spark {t1 - t0:6.2f}s duck {t2 - t1:6.2f}s", flush=True)
            if not ok:
                bad.append(name)
                if cols != ocols:
                    print("   columns", cols, ocols)
                gs, ws = set(got), set(want)
                print("   counts", len(got), len(want))
                for r in sorted(gs - ws)[:4]:
                    print("   spark only", str(r)[:400])
                for r in sorted(ws - gs)[:4]:
                    print("   sql only  ", str(r)[:400])
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[2:], sys.argv[1])
