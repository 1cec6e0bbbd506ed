"""Every query against its SQL on the smallest tables, and the driver's contract."""

import importlib.util
import sys

import pytest

import __spark_entry__ as entry
import check
from riskflow.catalog.oracle import ORACLE
from riskflow.catalog.queries import QUERIES
from riskflow.operators import profiles, skew

FOLDER = "/root/testdata/sf0.001"
#: Results of a trained model, which SQL does not have; test_training recomputes them.
OF_A_MODEL = {"model_importances", "model_top_features", "model_report", "model_score_rows"}


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLE) == set(QUERIES) - OF_A_MODEL


def test_the_rest_works_without_the_corpus_operators(monkeypatch):
    """Their folder may be missing, and a library of theirs, which is said; other errors inside it are not hidden."""
    for name in [n for n in sys.modules if n.startswith("riskflow.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "riskflow.llm", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE)
    monkeypatch.delitem(sys.modules, "riskflow.llm")
    monkeypatch.setitem(sys.modules, "pyarrow", None)
    if "riskflow.llm" in sys.modules or importlib.util.find_spec("riskflow.llm") and importlib.util.find_spec("riskflow.llm").origin:
        with pytest.warns(UserWarning, match="pyarrow"):
            assert set(entry.queries()) == set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query(spark, con, name):
    # at this size some results may be empty, as in SQL
    assert check.compare(spark, con, name, FOLDER) is None


def test_hot_customers_are_spread(spark, con, monkeypatch):
    """With few rows per task every busy user counts as hot, and nothing may change."""
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 12)
    for name in ("rolling_7d_features", "rapid_succession", "detected_patterns", "first_seen_flags"):
        assert check.compare(spark, con, name, FOLDER) is None, name


def scans(spark, name):
    """How often the events are read in the plan of a query."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("event_id#") and len([x for x in plan.split("\n") if "Relation" in x and "event_type#" in x])


def test_the_history_is_not_read_again(spark):
    assert scans(spark, "enhanced_transactions") == 1
    assert scans(spark, "detected_patterns_snapshot") <= 2 and scans(spark, "evidence_package") <= 2


def test_recent_counts_push_their_bound_down(spark, tmp_path):
    spark.sql("SELECT 'u' user_id, TIMESTAMP'2024-01-24 12:00:00' ts").write.parquet(str(tmp_path / "h"))
    out = profiles.recent_counts(spark.read.parquet(str(tmp_path / "h")), "2024-01-25 00:00:00")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-24" in plan and out.first().recent_count == 1
