"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from quernstone.functions import scratch

REPO = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_subpackage(tmp_path):
    shutil.copytree(REPO / "quernstone", tmp_path / "quernstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n == 'pipeline' for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 200 and said[1] == "False"


def test_works_without_a_library(tmp_path):
    """With the folder there but a library that it needs absent, the other queries still come."""
    (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError(\"No module named 'xxhash'\")\n")
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n == 'pipeline' or n.startswith('op1_') for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=REPO, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{REPO}"}, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 200 and said[1] == "False"


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        scratch.shared_dir(Session())
