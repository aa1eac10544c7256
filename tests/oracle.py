"""Runs registered queries against their DuckDB text and reports differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        return _cell(v.item())
    if type(v).__name__ in ("NaTType",):
        return None
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    def key(row):
        return tuple((isinstance(x, float), x is None, str(x + 0.0 if isinstance(x, float) else x)) for x in sorted(
            row, key=lambda x: isinstance(x, float)))

    return [columns[i] for i in order], sorted(out, key=key)


def compare(spark_df, con, sql):
    """Returns (problem or None, rows)."""
    mine = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}", len(mine[1])
    types = {type(v).__name__ for r in theirs[1] for v in r if v is not None}
    if "Decimal" in types:
        return "oracle yields Decimal", len(mine[1])
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}", len(mine[1])
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if repr(a) != repr(b)]
    if bad:
        return f"{len(bad)} of {len(mine[1])} rows differ, {mine[0]} e.g.\n    {bad[0][0]}\n    {bad[0][1]}", len(mine[1])
    return None, len(mine[1])


def main(argv):
    from sextant.session import build_session
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("sf"):
        sf = f"/root/testdata/{argv.pop(0)}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    con = connect(sf)
    queries, sqls = E.queries(), E.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    wrong = 0
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            if name in sqls:
                problem, n = compare(df, con, sqls[name])
            else:
                problem, n = None, len(df.collect())
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        wrong += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} rows={n} {'sql' if name in sqls else 'rows-only'} {time.time() - t:.1f}s", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print(f"{len(names)} queries, {wrong} wrong")
    return wrong


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
