"""Compare every query with its DuckDB statement. `python tests/oracle.py [sf_dir] [name part ...]`"""

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parents[1]))
import __spark_entry__ as contract  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, Decimal):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([canonical(r[i]) for i in order]) for r in rows)


def compare(spark, con, sf_dir, name, build, sql):
    df = build(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; only here {sorted(set(got) - set(want))[:2]}; only there {sorted(set(want) - set(got))[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def main():
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), contract.oracle_sql(), 0
    for name, build in contract.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, name, build, sqls[name])
            else:
                n = build(spark, sf_dir).count()
                problem = None if n else "no rows"
                name += f" (no SQL, {n} rows)"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:5.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed; statements without query: {sorted(set(sqls) - set(contract.queries()))}")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
