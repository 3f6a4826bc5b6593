"""Compare registered queries with their SQL: python tests/check_queries.py [sf] [name ...]."""

import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def compare(spark, con, sf_dir, name, make, sql):
    t = time.time()
    df = make(spark, sf_dir)
    got = df.collect()
    spark_s = time.time() - t
    columns = sorted(df.columns)
    if sql is None:
        return f"{name}: rows only, {len(got)} rows, {spark_s:.1f}s", True
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_s = time.time() - t
    if sorted(names) != columns:
        return f"{name}: COLUMNS {columns} vs {sorted(names)}", False
    a = sorted((tuple(canon(r[c]) for c in columns) for r in got), key=repr)
    at = [names.index(c) for c in columns]
    b = sorted((tuple(canon(r[i]) for i in at) for r in want), key=repr)
    ok = a == b
    note = f"{name}: {'ok' if ok else 'DIFFERENT'} {len(a)}/{len(b)} rows, spark {spark_s:.1f}s, sql {sql_s:.1f}s"
    if not ok:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        note += f"\n   {columns}\n   spark {only_a}\n   sql   {only_b}"
    return note, ok


def main():
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="boxframe-check-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wanted = sys.argv[2:]
    oracles, bad = oracle_sql(), []
    for name, make in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            note, ok = compare(spark, con, sf_dir, name, make, oracles.get(name))
        except Exception as error:
            note, ok = f"{name}: ERROR {str(error)[:600]}", False
        print(note, flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
