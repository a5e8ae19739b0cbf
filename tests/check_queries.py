"""Compare named queries with their SQL twins: check_queries.py SF_DIR [prefix ...]."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402
from peakwise.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    con = connect(sf_dir)
    oracle = entry_module.oracle_sql()
    bad = 0
    for name, fn in entry_module.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                problem = compare(con, df, oracle[name])
                note = problem or "ok"
            else:
                problem, note = None, f"rows only: {df.count()}"
        except Exception as exc:  # report and go on with the next query
            problem = note = f"{type(exc).__name__}: {str(exc)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {'' if note == 'ok' else note}", flush=True)
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
