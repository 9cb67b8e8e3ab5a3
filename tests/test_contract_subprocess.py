"""The driver imports __spark_entry__ from elsewhere with its own session: Python-worker
queries must still find this package on the executors."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as E
q = E.queries()
sf = "/root/testdata/sf0.001"
print("entry", E.entry(spark).count())
for name in ("daily_model_scores", "score_summary", "item_irony"):
    print(name, q[name](spark, sf).count())
"""


def test_queries_run_from_a_foreign_working_directory():
    cwd = tempfile.mkdtemp(prefix="murmur-driver-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    lines = dict(line.split() for line in out.stdout.strip().splitlines() if line.count(" ") == 1)
    assert int(lines["daily_model_scores"]) == 30 and int(lines["score_summary"]) == 1
    assert int(lines["item_irony"]) == 200 and int(lines["entry"]) > 0
