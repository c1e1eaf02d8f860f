"""Driver contract: the flagship runs on sf0.001 and every SQL oracle has a query."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test data not present")
def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "customernumber" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_works_without_the_optional_folders(tmp_path, with_pipeline):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "cartwise"), tmp_path / "cartwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline else [])):
        shutil.copy(os.path.join(here, name), tmp_path)
    code = "import __spark_entry__ as E; n = E.queries(); assert len(n) > 100 and not any(x.startswith('op1_') for x in n), n; E.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
