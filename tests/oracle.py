"""Side-by-side comparison of a registered query with its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir, fn, sql):
    """(message or None, number of rows)."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None, sum(got.values())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", 0
    if got != want:
        extra, lost = list((got - want).items()), list((want - got).items())
        return (f"{sum(got.values())} rows vs {sum(want.values())}; {len(extra)} only in Spark, "
                f"{len(lost)} only in SQL\n  spark: {str(extra[:2])[:600]}\n  sql:   {str(lost[:2])[:600]}"), 0
    return None, sum(got.values())


if __name__ == "__main__":
    import __spark_entry__ as entry

    from turnstone.session import builder

    sf = sys.argv[1]
    only = set(sys.argv[2:])
    spark = (builder("oracle", "local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            message, n = compare(spark, con, name, sf, fn, entry.oracle_sql().get(name))
        except Exception as exc:  # noqa: BLE001
            message, n = f"{type(exc).__name__}: {str(exc)[:1500]}", 0
        bad += message is not None
        print(f"{'FAIL' if message else 'ok  '} {name} rows={n} {time.time() - start:.1f}s "
              f"{'' if name in entry.oracle_sql() else '(rows only) '}{message or ''}", flush=True)
    print("failed:", bad)
