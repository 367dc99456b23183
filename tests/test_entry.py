import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_queries_and_oracles_have_the_same_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len([n for n in q if n.startswith("grid_")]) > 70


def test_entry_without_the_text_operators(tmp_path):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{here}/gridspark", tmp_path / "gridspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert q and o and not [n for n in q if not n.startswith('grid_')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 550
