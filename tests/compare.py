"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python tests/compare.py /root/testdata/sf0.01 [name ...]

Rows are compared as sorted multisets with columns sorted by name; doubles
are compared after rounding to 6 significant decimals.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    srows = df.collect()
    ts = time.time() - t
    scols = df.columns
    if sql is None:
        return f"{name}: spark {len(srows)} rows in {ts:.1f}s (no oracle)"
    t = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    td = time.time() - t
    sc, sr = canon(scols, srows)
    dc, dr = canon(dcols, drows)
    ok = sc == dc and sr == dr
    msg = f"{name}: {'OK ' if ok else 'DIFF'} spark {len(sr)} rows {ts:.1f}s, duck {len(dr)} rows {td:.1f}s"
    if not ok:
        if sc != dc:
            msg += f"\n   cols spark={sc}\n   cols duck ={dc}"
        else:
            bad = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            msg += f"\n   first diffs: {bad}"
    return msg


def main():
    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    from pivotscore.session import get_session
    spark = get_session("local[8]", 8)
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    for name in names or list(qs):
        try:
            print(compare(spark, con, name, qs[name], orc.get(name), sf_dir), flush=True)
        except Exception as exc:  # noqa: BLE001
            print(f"{name}: ERROR {type(exc).__name__}: {str(exc)[:400]}", flush=True)


if __name__ == "__main__":
    main()
