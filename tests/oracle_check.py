"""Compare queries with their SQL counterparts: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kind(type_name: str) -> str:
    """Spark's and the SQL engine's name of a type, brought together."""
    name = str(type_name).lower()
    return {"varchar": "string", "integer": "int", "boolean": "bool"}.get(name, name)


def compare(spark, con, name: str, query, oracle: str, sf_dir: str) -> str | None:
    """None when both agree, else what differs."""
    df = query(spark, sf_dir)
    result = con.execute(oracle)
    columns = [d[0] for d in result.description]
    expected = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    expected_kinds = {d[0]: kind(d[1]) for d in result.description}
    actual_kinds = {name: kind(type_) for name, type_ in df.dtypes}
    if expected_kinds != actual_kinds:
        return f"types {sorted(set(actual_kinds.items()) ^ set(expected_kinds.items()))}"
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if not expected:
        return "no rows expected"
    if actual != expected:
        here, there = set(actual), set(expected)
        extra, lacking = [r for r in actual if r not in there][:3], [r for r in expected if r not in here][:3]
        return f"{len(actual)} rows against {len(expected)}; extra {extra}; lacking {lacking}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        if name not in oracles:
            print(f"{name}: {queries[name](spark, sf_dir).count()} rows, no SQL")
            continue
        try:
            problem = compare(spark, connect(sf_dir), name, queries[name], oracles[name], sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        bad += problem is not None
        print(f"{name}: {problem or 'ok'}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
