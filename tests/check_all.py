"""Compare every query with its SQL at one scale: python tests/check_all.py SF_DIR [names]."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from compare import differences, duckdb_tables  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from skylag.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, statements, failed = duckdb_tables(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            if name in statements:
                problems = differences(frame, connection, statements[name])
                detail = "same"
            else:
                problems, detail = [], f"{frame.count()} rows, no SQL"
        except Exception as error:  # report and go on with the other queries
            problems = [str(error)[:1500]]
        failed += bool(problems)
        print(f"{name}: {problems or detail} ({time.time() - start:.1f}s)", flush=True)
    print(f"{failed} failed")
    sys.exit(bool(failed))
