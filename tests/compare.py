"""Compare registered queries with their SQL on the same Parquet files.

Run as ``python -m tests.compare [sf_dir] [name ...]``.
"""

import datetime as dt
import glob
import math
import os
import sys
import time

import duckdb

TESTDATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.isoformat(timespec="microseconds")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


def both(spark, con, registered, sf_dir):
    df = registered.run(spark, sf_dir)
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(registered.oracle)
    expected = _rows([d[0] for d in result.description], result.fetchall())
    return actual, expected


def main() -> int:
    from logweir.plans.catalog import CATALOG
    from logweir.session import session_builder

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else f"{TESTDATA}/sf0.01"
    names = sys.argv[2:] or list(CATALOG)
    spark = (
        session_builder()
        .master("local[8]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            (cols, rows), (wanted_cols, wanted) = both(spark, con, CATALOG[name], sf_dir)
        except Exception as e:  # report every query, then fail
            bad += 1
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
            continue
        same = cols == wanted_cols and rows == wanted
        print(f"{'ok  ' if same else 'DIFF'} {name} {len(rows)} {time.time() - start:.2f}s", flush=True)
        if not same:
            bad += 1
            print("   columns", cols, wanted_cols, "rows", len(rows), len(wanted))
            shown = [(a, b) for a, b in zip(rows, wanted) if a != b][:2]
            print("   first differences", shown)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
