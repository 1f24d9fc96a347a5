"""Run queries against their SQL at one scale: python tests/check.py [name-part ...]

CHECK_DIR names the tables. CHECK_BROADCAST=-1 turns measured broadcasts off, so that the joins
meant for two large sides are checked.
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from oracle import connect, difference  # noqa: E402

folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
         .config("spark.sql.autoBroadcastJoinThreshold", os.environ.get("CHECK_BROADCAST", "10MB"))
         .getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
sqls = entry.oracle_sql()
bad = 0
for name, run in entry.queries().items():
    if len(sys.argv) > 1 and not any(part in name for part in sys.argv[1:]):
        continue
    began = time.time()
    try:
        df = run(spark, folder)
        text = difference(df, con, sqls[name]) if name in sqls else f"no sql, {df.count()} rows"
    except Exception as error:  # report and go on
        text = f"{type(error).__name__}: {str(error)[:600]}"
    fine = text is None or text.startswith("no sql")
    bad += not fine
    print(f"{'ok ' if fine else 'BAD'} {name} {time.time() - began:.1f}s {text or ''}", flush=True)
print("bad:", bad)
