import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from bagmeter.operators import iterative
from bagmeter.sources.tables import ship, table
ship(spark)
spark.createDataFrame([(1, [0.5, 0.5])], "k int, q array<double>").write.mode("overwrite").parquet(sys.argv[2] + "/t.parquet")
out = iterative.solved_means(table(spark, sys.argv[2], "t"), ["k"], lambda q: q, ("a", "b"))
print("ROWS", out.count())
"""


def test_functions_reach_workers_that_do_not_have_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, root, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 2" in done.stdout, done.stderr[-2000:]
