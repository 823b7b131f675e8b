"""Run a named query and its SQL twin and compare them as sets of rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(base: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return ("decimal", str(v))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(repr, t))
    )


def compare(spark, con, fn, sql: str, base: str) -> str | None:
    """None when equal, else a short description of the difference."""
    df = fn(spark, base)
    cols = df.columns
    got = rows_of(cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    want = rows_of(ocols, cur.fetchall())
    if sorted(cols) != sorted(ocols):
        return f"columns {sorted(cols)} vs {sorted(ocols)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; first {got[:2]} vs {want[:2]}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"{sorted(cols)}: {g} vs {w}"
    return None


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from govlattice.session import build_session

    base = sys.argv[1]
    names = sys.argv[2:]
    spark = build_session(
        "compare",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(base)
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, fn, oracles[name], base)
                note = "ok" if diff is None else f"DIFF {diff}"
            else:
                diff = None
                note = f"rows {fn(spark, base).count()}"
        except Exception as e:  # noqa: BLE001
            diff = note = "ERROR " + str(e)[:700]
        bad += diff is not None
        print(f"{time.time() - start:6.1f}s {name}: {note[:900]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
