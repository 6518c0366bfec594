"""Runs registered queries and their oracle SQL side by side: python -m tests.oracle_check SF_DIR [name part ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "F" + format(round(v, 6) + 0.0, ".6f")
    if hasattr(v, "isoformat"):
        return str(v)
    return str(v)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short text."""
    df = fn(spark, sf_dir)
    got = _table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = _table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {sorted(set(got[0]) ^ set(want[0]))}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} against {len(want[1])}"
    if not want[1]:
        return "no rows"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return "; ".join(f"{c}: {x} against {y}" for c, x, y in zip(got[0], a, b) if x != y) + f" in {a[:6]}"
    return None


def main():
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from sievelog.session import local_session
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    oracles, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                n = fn(spark, sf_dir).count()
                diff = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {time.time() - start:6.2f}s {'sql ' if name in oracles else 'rows'} "
              f"{name}{'' if diff is None else '  ' + diff}", flush=True)
        spark.catalog.clearCache()
    print("bad:", bad)


if __name__ == "__main__":
    main()
