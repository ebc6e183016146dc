"""Compare registered queries with their DuckDB SQL, order-insensitively."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 6)))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if hasattr(v, "is_integer"):
        return canon(float(v))
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(canon(r[i]) for i in order) for r in data)


def near(x, y):
    """Equal rows, rounded figures apart by at most their last digit."""
    for u, v in zip(x.split("|"), y.split("|")):
        if u != v:
            try:
                if abs(float(u) - float(v)) > 1.5e-6:
                    return False
            except ValueError:
                return False
    return x.count("|") == y.count("|")


def check(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        return False, "the plan holds a cross join"
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return True, f"rows-only {len(got)} rows {took:.1f}s"
    t0 = time.time()
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want = res.fetchall()
    dtook = time.time() - t0
    if sorted(want_cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(want_cols)}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a == b:
        kinds = {d[0]: str(d[1]) for d in res.description}
        return True, f"{len(a)} rows {took:.1f}s duck {dtook:.1f}s" + ("  EMPTY" if not a else "")
    if len(a) == len(b) and all(near(x, y) for x, y in zip(a, b)):
        return True, f"{len(a)} rows {took:.1f}s (equal up to the last rounded digit)"
    sa, sb = set(a), set(b)
    only_a, only_b = [x for x in a if x not in sb][:2], [x for x in b if x not in sa][:2]
    return False, f"{len(a)} vs {len(b)} rows {took:.1f}s\n   spark: {str(only_a)[:900]}\n   duck : {str(only_b)[:900]}"


def main(names):
    import __spark_entry__ as entry
    from fathomline.session import local_session

    sf = "/root/testdata/sf0.01"
    if names and names[0].startswith("sf"):
        sf = "/root/testdata/" + names.pop(0)
    if "--plain" in names:  # as a driver without settings of ours would run it
        from pyspark.sql import SparkSession

        names.remove("--plain")
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(8)
    con = duck(sf)
    q, o = entry.queries(), entry.oracle_sql()
    pick = [n for n in q if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    bad = []
    for n in pick:
        try:
            ok, msg = check(spark, con, n, q[n], o.get(n), sf)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(("ok  " if ok else "BAD ") + n + ": " + msg, flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(pick) - len(bad)}/{len(pick)} ok; bad: {bad}; no oracle: {[n for n in pick if n not in o]}")


if __name__ == "__main__":
    main(sys.argv[1:])
