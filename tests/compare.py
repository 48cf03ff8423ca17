"""Run registered queries in Spark and DuckDB and compare rows, types and values.

    python tests/compare.py [sf dir] [name ...]
"""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(os.path.join(sf, "*.parquet")):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(canon(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, name, run, sql, sf):
    t0 = time.time()
    df = run(spark, sf)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return len(got) > 0, f"{len(got)} rows (no SQL twin) {t1 - t0:.2f}s"
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {df.columns} / {cols}"
    if got != want:
        gs, ws = set(map(repr, got)), set(map(repr, want))
        a, b = sorted(gs - ws), sorted(ws - gs)
        return False, f"{len(got)} / {len(want)} rows, {len(a)} differ\n    spark {a[:3]}\n    sql   {b[:3]}"
    return len(got) > 0, f"{len(got)} rows, spark {t1 - t0:.2f}s sql {t2 - t1:.2f}s"


def main():
    from loomcast.session import build_session
    from loomcast.suite import load

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.001"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, n = connect(sf), [], 0
    for name, q in load().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        n += 1
        try:
            ok, msg = compare(spark, con, name, q.run, q.sql, sf)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            bad.append(name)
        print("ok  " if ok else "FAIL", name, msg, flush=True)
    print(f"{n - len(bad)} of {n} match; failing: {bad}")


if __name__ == "__main__":
    main()
