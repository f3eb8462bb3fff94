"""The driver imports __spark_entry__ from another working directory with its own
plain session: pandas-worker queries must still import the package (shipped with
addPyFile)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
q = E.queries()
print("N", q["similar_vectors"](spark, "/root/testdata/sf0.001").count(),
      q["lockout_audit"](spark, "/root/testdata/sf0.001").count(), len(E.entry(spark).collect()))
"""


def test_queries_run_from_another_directory():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.mkdtemp(), env=env,
                         capture_output=True, text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("N ")]
    assert line, out.stderr[-3000:]
    n_sim, n_lock, n_entry = map(int, line[0].split()[1:])
    assert n_sim > 0 and n_lock > 0 and n_entry > 0
