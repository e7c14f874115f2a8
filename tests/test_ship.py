import os
import subprocess
import sys

import pytest

from tellurion.plans.ship import ROOT, importable

CODE = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("ROWS", len(e.entry(s).collect()))
"""


def test_queries_run_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in done.stdout


@pytest.mark.parametrize(("master", "found"), [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False), ("k8s://host", False)])
def test_only_workers_on_this_machine_share_its_folder(master, found, monkeypatch):
    """Started in the package's folder."""
    monkeypatch.chdir(ROOT)
    assert importable(master) == found


def test_workers_that_start_elsewhere_are_sent_the_package(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("PYTHONPATH", raising=False)
    assert not importable("local[4]")
