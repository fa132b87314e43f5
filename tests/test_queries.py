"""Registered queries against their SQL, on the smallest tables, and without the optional modules."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from vigil import queries as core

DATA = "/root/testdata/sf0.001"
SOME = ["a01_snapshot", "a06_application_summary", "i05_clusters", "i19_drift", "a24_application_comparison", "e07_ablation", "k03_candidate_sweep", "t07_coverage_nli", "r07_toxicity_phrases", "l02_decision_steps", "g01_half_trend"]


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    cell = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_spark_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    assert plain(core.QUERIES[name](spark, DATA).toPandas()) == plain(db.execute(core.SQL[name]).df())


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_works_without_the_optional_modules(tmp_path, gone):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
