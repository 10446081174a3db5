"""Command line: compare queries with their SQL. Usage: run_oracle.py FOLDER [NAME ...]"""

import sys
import time

sys.path.insert(0, "/".join(__file__.split("/")[:-2]))
import __spark_entry__ as entry  # noqa: E402
from seamark.session import get_session  # noqa: E402
from tests import oracle  # noqa: E402

folder, names = sys.argv[1], sys.argv[2:]
spark = get_session(master="local[8]", **{
    "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "8g"})
spark.sparkContext.setLogLevel("ERROR")
con = oracle.connect(folder)
sqls = entry.oracle_sql()
bad = 0
for name, run in entry.queries().items():
    if names and not any(n in name for n in names):
        continue
    start = time.time()
    spent = 0.0
    try:
        mine = oracle.spark_rows(run(spark, folder))
        spent = time.time() - start
        if name in sqls:
            verdict = oracle.compare(mine, oracle.duck_rows(con, sqls[name])) or f"ok {len(mine[0])} columns"
        else:
            verdict = "rows only:"
        verdict += f" {len(mine[1])} rows" + ("  EMPTY" if not mine[1] else "")
    except Exception as error:  # noqa: BLE001
        verdict = f"ERROR {type(error).__name__} {str(error)[:1500]}"
    if not verdict.startswith(("ok", "rows only")):
        bad += 1
    print(f"{name:34s} spark {spent:6.2f}s sql {time.time() - start - spent:6.2f}s {verdict}", flush=True)
print("failing:", bad)
