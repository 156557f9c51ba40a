"""The package as a zip file, without the corpus operators as with them, can be imported; queries run from any folder."""

import os
import subprocess
import sys
import zipfile

from faunaflux import shipping

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_archive_can_be_imported(tmp_path):
    path = shipping.archive(ROOT, f"{tmp_path}/faunaflux.zip")
    assert "faunaflux/operators/newton.py" in zipfile.ZipFile(path).namelist()
    done = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {path!r}); import faunaflux.operators.graphs as g; print(g.__file__)"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert "faunaflux.zip" in done.stdout


def test_queries_with_python_workers_run_from_another_folder(tmp_path):
    """A fresh process in an empty folder, which knows the repository by its path alone."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("rows", e.queries()["logistic_gradient"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "rows 25" in done.stdout, done.stderr[-2000:]
