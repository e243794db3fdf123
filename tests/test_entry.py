"""The driver contract, and every SQL twin at the smallest scale."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle_harness import compare, connect

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_keys():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) > 150


def test_entry_without_the_corpus_operators(tmp_path):
    """Without the operators' folders, and without the pipeline, both functions still give everything else."""
    root = Path(entry.__file__).parent
    for part in ("veneer", "workload"):
        shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(k.startswith('op1_') for k in q), 'pipeline' in q)"

    def counts():
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        return done.stdout.split()

    rest = [k for k in QUERIES if not re.match(r"op\d+_|pipeline$", k)]
    assert counts() == [str(len(rest)), "True", "False", "False"]
    (tmp_path / "corpus_pipeline.py").unlink()
    assert counts() == [str(len(rest)), "True", "False", "False"]


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["pair_id", "imbalance"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    rows, problem = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert problem is None, problem
    assert rows > 0


def test_plans_keep_text_work_in_codegen_and_prune_columns(spark):
    plan = QUERIES["features_surface10_text"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    scan = QUERIES["predictions_last_wins"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in scan.split("ReadSchema")[1].splitlines()[0]


def test_repeated_runs_agree(spark):
    """Same result whatever the partitioning of the shuffles."""
    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            return sorted(map(tuple, QUERIES["permutation_calibration"](spark, SF).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert run("2") == run("13")
