"""Run registered queries against DuckDB on the same tables: ``python tests/oracle.py [sf_dir] [name ...]``."""

import os
import sys
import time
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    if hasattr(value, "asDict"):
        return tuple(map(normal, value))
    if type(value).__name__ == "Decimal":
        return normal(float(value))
    return value


def compare(spark, name, query, sql, sf_dir):
    """None if the rows agree, else what differs."""
    import duckdb

    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    mine = Counter(tuple(normal(r[c]) for c in columns) for r in df.collect())
    with duckdb.connect() as db:
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = db.sql(sql)
        if sorted(found.columns) != columns:
            return f"{name}: columns {columns} and {sorted(found.columns)}"
        at = [found.columns.index(c) for c in columns]
        theirs = Counter(tuple(normal(r[i]) for i in at) for r in found.fetchall())
    if mine == theirs:
        return None
    extra, missing = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
    return f"{name}: {sum(mine.values())} and {sum(theirs.values())} rows; {columns}; only here {extra}; only there {missing}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", "/tmp/oracle-warehouse").config("spark.checkpoint.dir", "file:///tmp/oracle-warehouse/_shared").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    for key, sql in entry.oracle_sql().items():
        if len(sys.argv) < 3 or key in sys.argv[2:]:
            began = time.time()
            try:
                said = compare(session, key, entry.queries()[key], sql, where)
            except Exception as e:  # a report of all queries, not a stop at the first
                said = f"{key}: {str(e)[:1500]}"
            print("ok  " if said is None else "FAIL", key if said is None else said, f"{time.time() - began:.1f}s", flush=True)
