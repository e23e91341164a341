"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
DATA = "/root/testdata/sf{}"


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_norm(v) for v in row) for row in df.select(*cols).collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], sorted(rows), dict(zip(names, [str(d[1]) for d in cur.description]))


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from filelake.session import local_session

    sf = argv[0] if argv else "0.001"
    sf_dir = DATA.format(sf)
    spark = local_session(8)
    con = connect(sf_dir)
    oracles, all_queries, bad = oracle_sql(), queries(), []
    wanted = [n for n in all_queries if not argv[1:] or any(a in n for a in argv[1:])]
    for name in wanted:
        start = time.time()
        try:
            cols, rows = spark_rows(all_queries[name](spark, sf_dir))
            took = time.time() - start
            if name not in oracles:
                print(f"--   {name:34s} rows={len(rows):7d} {took:6.1f}s (no SQL)", flush=True)
                continue
            dcols, drows, _ = duck_rows(con, oracles[name])
            ok = cols == dcols and rows == drows
            print(f"{'ok' if ok else 'BAD':4s} {name:34s} rows={len(rows):7d}/{len(drows):7d} {took:6.1f}s", flush=True)
            if not ok:
                bad.append(name)
                if cols != dcols:
                    print("   columns", cols, dcols)
                else:
                    a, b = set(rows), set(drows)
                    print("   spark only", sorted(a - b)[:3])
                    print("   duck only ", sorted(b - a)[:3])
        except Exception as e:  # noqa: BLE001 - keep comparing the other queries
            bad.append(name)
            print(f"ERR  {name}: {str(e)[:1500]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
