"""A choice of registered queries against their SQL; the rest of them are run in the same way outside the tests."""

import math
import os
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
duckdb = pytest.importorskip("duckdb")
SHOWN = ["ind_ht_trendmode", "ind_sarext", "presets_overlap_0", "mat1_greedy_tolerance_3", "swp2_6_sampled_grid", "prd7_shared_outputs", "src1_arrow_symbols", "as6_all_statistics", "flagship", "ind_bbands", "ind_kama", "ind_adx", "prd1_5_conditions", "prd6_7_strategy", "lab4_periods", "lab3_best_offset", "trd1_2_pairs", "trd5_6_closed", "mat2_score", "swp4_sensitivity", "ds2_shifted", "aln1_align", "ml5_strided_sequences", "ml11_threshold_sweep", "as7_rules", "log6_7_ranges", "log13_15_tests", "pop2_credit", "txt1_summary"]


def rows(names, data):
    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool):
            return str(v)
        return str(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) else str(v)

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(text(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def other(sf):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SHOWN)
def test_query_is_its_sql(spark, sf, other, name):
    df = __spark_entry__.queries()[name](spark, sf)
    found = other.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_are_listed_without_a_session():
    import subprocess

    code = "import __spark_entry__ as e; from pyspark.sql import SparkSession; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 150 and SparkSession.getActiveSession() is None"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
