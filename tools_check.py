"""Run every registered query against its DuckDB oracle and print a line per query.

usage: python tools_check.py [sf_dir] [name ...]
"""
import sys
import time

from medialens.plans.compare import compare, duck
from medialens.plans.registry import oracle_sql, queries
from medialens.session import build_session

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = build_session("local[8]", shuffle_partitions=8, app_name="check")
spark.sparkContext.setLogLevel("ERROR")
con = duck(sf)
q, o = queries(), oracle_sql()
bad = 0
for n in (names or sorted(q)):
    t = time.time()
    if n not in o:
        try:
            c = q[n](spark, sf).count()
            print(f"ROWS  {n}: {c} rows ({time.time()-t:.1f}s)")
        except Exception as e:
            bad += 1
            print(f"ERROR {n}: {type(e).__name__}: {str(e)[:300]}")
        continue
    try:
        r = compare(spark, con, n, q[n], o[n], sf)
        tag = "OK   " if r["ok"] else "FAIL "
        bad += 0 if r["ok"] else 1
        print(f"{tag} {n}: rows={r['rows']} cols_ok={r['cols_ok']} hash_ok={r['hash_ok']} ({time.time()-t:.1f}s)")
        if not r["cols_ok"]:
            print("      ", r["cols"])
    except Exception as e:
        bad += 1
        print(f"ERROR {n}: {type(e).__name__}: {str(e)[:400]}")
print(f"{len(names or q)} checked, {bad} bad")
