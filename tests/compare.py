"""Runs every registered query against its SQL in DuckDB. Usage: compare.py [sf_dir] [name part …]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def difference(spark_df, con, sql):
    """None when equal as multisets of rows, else a description."""
    rows = [tuple(r[c] for c in sorted(spark_df.columns)) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {names} against {spark_df.columns}"
    order = [names.index(c) for c in sorted(names)]
    other = [tuple(r[i] for i in order) for r in cur.fetchall()]
    if len(rows) != len(other):
        return f"{len(rows)} rows against {len(other)}"
    a, b = sorted(rows, key=key), sorted(other, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ; columns {sorted(names)}; first {bad[0][0]} against {bad[0][1]}"
    return None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    parts = [a for a in args if not a.startswith("/")]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                note = problem or "equal"
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
                note = f"{n} rows, no SQL"
        except Exception as e:
            problem = note = f"{type(e).__name__}: {" ".join(str(e).split())[:400]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
