"""Every query outside the llm subpackage runs, and those with SQL agree with it (sf0.001)."""

import os

import duckdb
import pytest

from procaudit import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data are not here")
QUICK = ["code_report", "training_set", "plan_updates", "normalize_percent", "parse_fees_lenient", "threshold_sweep", "class_report", "tfidf_fit", "template_top3", "nn_predict", "match_history", "predict_from_history", "predict_batch", "request_candidates", "optional_filters", "nn_embeddings", "apply_updates", "actual_vs_predicted", "code_set_diff", "multilabel_predict", "write_model", "predict_stored_scores", "history_score", "best_candidate", "hours_by_encoder", "template_top3_bounded"]


def test_registry():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(columns).collect())))
    found = con.execute(catalog.oracle_sql()[name])
    order = [[c[0] for c in found.description].index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def test_summary_with_its_sample_is_that_of_sql(spark):
    """the query and its SQL left the first changes out."""
    import json

    test_same_as_sql(spark, "run_summary")
    row = catalog.queries()["run_summary"](spark, SF).first()
    sample = json.loads(row["sample"])
    assert len(sample) == min(20, row["updates"]) > 0 and all({"new_time", "new_fee"} & set(s) for s in sample)
    assert [s["id"] for s in sample] == sorted(s["id"] for s in sample)
