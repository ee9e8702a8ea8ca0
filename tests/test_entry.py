"""The driver's contract: names, SQL, and that the corpus part can be absent."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
ENGINE = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple(repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in frame.itertuples(index=False))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ENGINE)
def test_engine_query_against_sql(spark, name):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    got, want = entry.queries()[name](spark, str(DATA)).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("gone", [("tesselith/llm", "tests/llm"), ("tesselith/llm", "tests/llm", "corpus_pipeline.py")])
def test_engine_stands_without_the_corpus_part(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for x in gone:
        at = copy / x
        shutil.rmtree(at, ignore_errors=True) if at.is_dir() else at.unlink(missing_ok=True)
    code = "import __spark_entry__ as e\nassert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())\n"
    for command in (["-c", code], ["-m", "pytest", "-q", "--collect-only", "tests"], ["-m", "pytest", "-q", "-x", "tests/test_metadata.py"]):
        done = subprocess.run([sys.executable, "-B", *command], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=600)
        assert done.returncode == 0, done.stdout + done.stderr
