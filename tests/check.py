"""python -m tests.check [sf_dir] [name-substring ...]: compare every registered query with DuckDB."""

import sys
import time
import traceback

from tapewire.session import build_session
from tests.oracle import compare, duck

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2:]
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    con = duck(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad, slow = [], []
    for name, fn in queries.items():
        if want and not any(w in name for w in want):
            continue
        t0 = time.time()
        try:
            if name in sql:
                diff = compare(spark, con, sf, fn, sql[name])
            else:
                n = len(fn(spark, sf).collect())
                diff = None if n else "EMPTY"
        except Exception as exc:  # report and go on
            text = "".join(traceback.format_exception_only(exc))
            causes = [line[:300] for line in text.splitlines() if line.startswith("Caused by") or "\t- object" in line]
            diff = text[:700] + "\n".join(causes)
            if want:
                traceback.print_exc()
        took = time.time() - t0
        slow.append((took, name))
        if diff:
            bad.append(name)
            print(f"FAIL {name} {took:.1f}s {diff}", flush=True)
        elif want:
            print(f"ok {name} {took:.1f}s", flush=True)
    print(f"{len(slow)} run, {len(bad)} differ: {bad}; without SQL {[n for n in queries if n not in sql]}")
    print("slowest", sorted(slow, reverse=True)[:12], "total", sum(t for t, _ in slow))
