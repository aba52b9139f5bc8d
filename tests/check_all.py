"""Check every registered query against its SQL: python tests/check_all.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

import __spark_entry__ as entry  # noqa: E402
from compare import connect, mismatch  # noqa: E402
from filmfold.session import build_session  # noqa: E402


def main(sf_dir="/root/testdata/sf0.01", *names):
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            problem = mismatch(df, con, sql[name]) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as error:  # report and go on with the others
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{time.time() - start:6.2f}s {name}: {problem or 'ok'}", flush=True)
    print("not ok:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
