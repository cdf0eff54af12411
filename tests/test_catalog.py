"""Every registered query of the engine against its SQL, and the registry without the training-data folders."""

import os
import shutil
import subprocess
import sys

import pytest

from wordmill.plans import catalog, documents, russian  # noqa: F401

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr([r[c] for c in columns]) for r in got.collect())
    if name not in catalog.ORACLES:
        assert name == "tuned_weights"
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr([r[i] for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("pipeline", [False, True])
def test_registry_without_the_training_data_folders(tmp_path, pipeline):
    """The entry module imports where the folders and the pipeline are absent, and says so by having fewer queries."""
    shutil.copytree(f"{REPO}/wordmill", tmp_path / "wordmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    if pipeline and os.path.exists(f"{REPO}/corpus_pipeline.py"):  # left behind, it has nothing to import
        shutil.copy(f"{REPO}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert 'lex_coverage' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
