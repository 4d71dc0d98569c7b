"""Run named (or all) queries against DuckDB and print timings: ``python tests/check.py [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, duck, folder  # noqa: E402
from riskspark.queries import all_queries, all_sql  # noqa: E402
from riskspark.session import build_session  # noqa: E402

if __name__ == "__main__":
    args = sys.argv[1:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder())
    qs, sql = all_queries(), all_sql()
    args = [a for a in args if a != "-v"]
    names = [n for n in qs if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, folder())
            res = compare(df, con, sql[n]) if n in sql else "rows-only " + str(df.limit(6).collect() if "-v" in sys.argv else df.count())
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        ok = res is None or res.startswith("rows-only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - t0:6.2f}s {n} {res or ''}", flush=True)
    print("failures:", bad)
