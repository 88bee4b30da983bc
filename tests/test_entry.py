"""The driver's entry points, and that the rest stands without the llm folders."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from catalume.plans.queries import ORACLES, REGISTRY

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, list):
        return tuple(map(shown, value))
    return round(float(value), 6) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, duck, name):
    found = REGISTRY[name](spark, DATA)
    names = sorted(found.columns)
    got = sorted((tuple(shown(r[n]) for n in names) for r in found.collect()), key=str)
    sql = duck.execute(ORACLES[name])
    have = [d[0] for d in sql.description]
    assert sorted(have) == names
    assert got == sorted((tuple(shown(r[have.index(n)]) for n in names) for r in sql.fetchall()), key=str)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_without_llm(tmp_path, also):
    """The llm folders are gone, with or without the pipeline's module: queries are read, the other tests are found, and some run."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *also))
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(ROOT)]
    clean = os.environ | {"PYTHONPATH": os.pathsep.join(paths), "PYTEST_ADDOPTS": "-p no:cacheprovider"}

    def run(*args):
        done = subprocess.run([sys.executable, *args], cwd=tmp_path / "r", env=clean, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True)
        assert done.returncode == 0, done.stdout[-3000:]
        return done.stdout

    run("-c", "import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 60 and 'pipeline' not in e.queries()")
    found = run("-m", "pytest", "tests", "--collect-only", "-q")
    assert "test_like_sql" in found and not any(line.startswith("tests/llm/") for line in found.splitlines())
    run("-m", "pytest", "tests", "-q", "-k", "test_like_sql and (fold_accents or vector_norm_gate)")
