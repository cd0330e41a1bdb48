"""Run registered queries against their SQL: python tests/run_queries.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from compare import connect, difference  # noqa: E402
from corpusloom.plans.queries import registry  # noqa: E402
from corpusloom.session import session  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name, (query, sql) in registry().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            frame = query(spark, folder)
            problem = difference(frame, connection, sql) if sql else f"rows only: {frame.count()}"
        except Exception as failure:
            problem = "".join(traceback.format_exception_only(failure)).strip()[:1500]
        bad += problem is not None and bool(sql)
        print(f"{name:28s} {time.time() - started:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
