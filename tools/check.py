"""Runs registered queries beside their SQL and compares the rows.

usage: python tools/check.py [sf_dir] [name-prefix ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from textguard import plans  # noqa: E402
from textguard.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = []
    for name, run in plans.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            got = rows_of(df.columns, df.collect())
            spent, start = time.time() - start, time.time()
            sql = plans.ORACLES.get(name)
            if sql is None:
                print(f"ROWS {name}: {len(got)} rows, {spent:.1f}s", flush=True)
                continue
            result = con.execute(sql)
            columns = [d[0] for d in result.description]
            types = {d[0]: str(d[1]) for d in result.description}
            want = rows_of(columns, result.fetchall())
        except Exception as err:
            print(f"FAIL {name}: {str(err)[:1500]}", flush=True)
            bad.append(name)
            continue
        same = sorted(columns) == sorted(df.columns) and got == want
        print(f"{'ok  ' if same else 'DIFF'} {name}: {len(got)} rows, spark {spent:.1f}s, sql {time.time() - start:.1f}s", flush=True)
        if not same:
            bad.append(name)
            print("  spark", sorted(df.dtypes), "\n  sql  ", sorted(types.items()), len(want))
            print("  only spark", [r for r in got if r not in set(want)][:3])
            print("  only sql  ", [r for r in want if r not in set(got)][:3])
    print("bad:", bad)


if __name__ == "__main__":
    main()
