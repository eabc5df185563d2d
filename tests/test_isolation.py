"""The package works where it is not installed, and its oracles where Spark's own files are elsewhere."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=600)


def test_oracles_need_no_spark(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
sys.modules["pyspark"] = None
import oracles
assert len(oracles.oracle_sql()) > 100
"""
    done = run(code, tmp_path)
    assert done.returncode == 0, done.stderr


def test_workers_get_the_package_with_the_functions(tmp_path):
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {REPO!r} + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.queries()["detect_anomalies"](spark, "/root/testdata/sf0.001").count() > 0
"""
    done = run(code, tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
