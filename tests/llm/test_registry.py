"""The folder's queries, their SQL, and the library without the folder."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from docloom import llm
from tests.compare import compare, duck

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in llm.queries()} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
    assert set(llm.queries()) <= names and set(llm.oracles()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(llm.oracles()))
def test_query_against_sql(spark, sf_dir, name):
    assert compare(entry.queries()[name](spark, sf_dir), duck(sf_dir), llm.oracles()[name]) is None


def test_line_dedup_runs_no_python(spark, sf_dir):
    text = entry.queries()["op7_line_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))


def test_library_without_the_folder(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') for n in q) and set(q) == set(e.oracle_sql())"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)
    # every test of the rest can be imported as well
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=env, check=True)
