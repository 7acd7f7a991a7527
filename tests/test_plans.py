"""Plan shapes that must hold at any size."""

import pytest

from ledgerlens.operators import locate as X
from ledgerlens.plans import QUERIES

BATCH = [n for n in QUERIES if not n.startswith("stream_")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_join(spark, sf_dir, name):
    text = plan(QUERIES[name].run(spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    text = plan(QUERIES["job_state"].run(spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in text
    assert "Not(EqualTo(event_type,click))" in text


def test_no_python_outside_text_and_provider(spark, sf_dir):
    for name in ("validation_flags", "reply_fields", "merge_passes", "build_po", "export_json", "locate_exact", "health_asof"):
        assert "Python" not in plan(QUERIES[name].run(spark, sf_dir)), name


def test_lines_join_by_block(spark, sf_dir):
    from ledgerlens.plans.line_queries import fx_lines, fx_values

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(X.locate_exact(fx_values(spark, sf_dir), fx_lines(spark, sf_dir)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(document_id" in text and "_block" in text


def test_first_lines_limit_before_the_shuffle(spark, sf_dir):
    from ledgerlens.plans.line_queries import fx_lines

    text = plan(X.first_lines(fx_lines(spark, sf_dir)))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_words_do_not_cross_the_network(spark, sf_dir):
    text = plan(QUERIES["text_lines"].run(spark, sf_dir))
    assert 0 < text.index("posexplode") < text.index("Exchange")


def test_field_rows_do_not_cross_the_network(spark, sf_dir, monkeypatch):
    """Only headers do, before eleven rows are made of each."""
    from ledgerlens.operators import frames

    seen = []
    monkeypatch.setattr(frames, "written", lambda df, name: seen.append(plan(df)) or df)
    from ledgerlens.plans.reply_queries import merged

    merged(spark, sf_dir)
    (text,) = seen
    assert "FullOuter" in text and 0 < text.index("explode(") < text.index("Exchange")
