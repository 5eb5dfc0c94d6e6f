"""Compare registered queries with their DuckDB SQL on one data folder: python -m tests.oracle sf0.01 [names...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (int, bool)):
        return float(x) if not isinstance(x, bool) else x
    if hasattr(x, "as_tuple"):
        return float(f"{float(x):.9g}")
    return x


def compare(spark, con, name, f, sql, sf_dir) -> str:
    """An empty string, or what differs."""
    df = f(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(_cell(v) for v in r) for r in df.select(*names).collect())
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return f"columns {names} against {sorted(cols)}"
    at = [cols.index(c) for c in names]
    want = Counter(tuple(_cell(r[i]) for i in at) for r in rel.fetchall())
    if not got:
        return "no rows"
    if got != want:
        return f"{sum(got.values())} rows against {sum(want.values())}; only Spark: {list((got - want))[:3]}; only SQL: {list((want - got))[:3]} of {names}"
    return ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, only = f"/root/testdata/{sys.argv[1]}", sys.argv[2:]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "5g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, oracles = duck(sf_dir), entry.oracle_sql()
    for name, f in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            said = compare(spark, con, name, f, oracles[name], sf_dir) if name in oracles else f"rows only: {f(spark, sf_dir).count()}"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name:26} {time.time() - start:5.1f} s  {said or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
