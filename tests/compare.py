"""Runs catalog queries next to their SQL twins.

``python tests/compare.py [sf_dir] [name-prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SPARK_KIND = {"bigint": "int", "int": "int", "smallint": "int", "double": "double", "string": "text", "boolean": "bool"}
DUCK_KIND = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "text", "BOOLEAN": "bool"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def sorted_rows(rows, order):
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


def compare(df, con, sql: str) -> str:
    """Empty when the results agree, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = [str(d[1]) for d in cursor.description]
    expected = cursor.fetchall()
    got = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    duck_types = dict(zip(names, kinds))
    bad = [
        f"{n}: {t} vs {duck_types[n]}" for n, t in df.dtypes
        if SPARK_KIND.get(t, t) != DUCK_KIND.get(duck_types[n].upper(), duck_types[n]) and duck_types[n].upper() != 'NULL'
    ]
    if bad:
        return "types " + ", ".join(bad)
    columns = sorted(names)
    left = sorted_rows(got, [df.columns.index(c) for c in columns])
    right = sorted_rows(expected, [names.index(c) for c in columns])
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            diff = [(c, str(x)[:80], str(y)[:80]) for c, x, y in zip(columns, a, b) if x != y]
            return f"values {diff[:3]}"
    return ""


def main() -> None:
    import __spark_entry__ as entry
    from riskloom import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = session.build("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                verdict = "ok" if not problem else "DIFF " + problem
            else:
                verdict = f"rows {df.count()}"
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict = "FAIL " + " ".join(str(error).split())[:600]
        bad += verdict.startswith(("DIFF", "FAIL"))
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
