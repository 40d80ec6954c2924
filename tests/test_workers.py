"""Queries with Python kernels run where the package is not importable for workers."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
for name in ("m02_project", "m09_lloyd_step", "m11_mahalanobis", "m23_truncation_errors",
             "a18_nan_aware_covariance", "s16_read_tar_gz"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("all ran")
"""


def test_kernels_run_from_another_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=str(REPO)))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True,
                          text=True, timeout=300, env={**os.environ,
                                                       "PYTHONPATH": ""})
    assert "all ran" in done.stdout, done.stderr[-2000:]
