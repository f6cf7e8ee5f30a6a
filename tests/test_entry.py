import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from lectern.plans import registry  # noqa: E402


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql()) and registry.FLAGSHIP in registry.queries()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500


@pytest.mark.parametrize("gone", [["llm", "corpus_pipeline.py"], ["llm"]])
def test_the_rest_stands_without_the_training_data_operators(tmp_path, gone):
    """Entry and the tests that are left run with the folders deleted, whether or not the pipeline's file is."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(x for x in e.queries() if x.startswith('op') and x[2].isdigit()), 'pipeline' in e.queries())"
    run = lambda *args: subprocess.run([sys.executable, "-B", *args], cwd=tmp_path / "r", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    out = run("-c", code)
    assert out.stdout.strip() == f"{len(registry.queries())} [] False", out.stderr
    if len(gone) > 1:
        out = run("-m", "pytest", "-q", "-p", "no:cacheprovider", "tests", "--co")
        assert out.returncode == 0 and "error" not in out.stdout, out.stdout


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(lambda x: x.notna(), None)
    tidy = lambda v: (str(int(v)) if v.is_integer() else repr(round(v, 9))) if isinstance(v, float) else str(v)
    return sorted(tuple(map(tidy, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
