"""Reply cleaning, field rows, provider isolation."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import passes as P, replies as R

REPLIES = [
    ('{"po_number": {"value": "A", "confidence": 0.9}}', "clean", "A"),
    ('```json\n{"po_number": {"value": "B"}}\n```', "clean", "B"),
    ('Here: {"po_number": {"value": "C"}} and {that}', "clean", "C"),
    ('{"po_number": {"value": "D}{"}} ok', "clean", "D}{"),
    ('{"po_number": {"value": "E"}, "po_date": {"val', "recovered", "E"),
    ('{"po_number": {"value": "F"}, "x": }', "recovered", "F"),
    ("nothing here", "failed", None),
    ("", "failed", None),
    (None, "failed", None),
]


@pytest.mark.parametrize("case", range(len(REPLIES)))
def test_cleaning(spark, case):
    raw, status, value = REPLIES[case]
    cleaned = R.clean_replies(spark.createDataFrame([(1, raw)], "document_id int, raw_response string"))
    assert cleaned.first()["reply_status"] == status
    fields = R.reply_fields(cleaned).filter("field_path = 'po_number'").first()
    assert fields["value"] == value


def test_field_rows(spark):
    raw = ('{"po_number": "bare", "po_date": null, "vendor.name": {"value": "Acme Tools", "confidence": "90"}, '
           '"due_date": {"value": null, "confidence": 0.9}, "line_items": [{"description": "x"}], "other": 1, '
           '"payment_terms": {"value": "Net 30 days", "confidence": "sure"}}')
    replies = spark.createDataFrame([(1, raw)], "document_id int, raw_response string")
    texts = spark.createDataFrame([(1, "From ACME tools\nnet terms 30")], "document_id int, ocr_text string")
    rows = {r["field_path"]: r for r in R.reply_fields(R.clean_replies(replies), texts).collect()}
    assert len(rows) == 32
    assert (rows["po_number"]["value"], rows["po_number"]["confidence"], rows["po_number"]["review_reason"]) == ("bare", 0.7, "low_confidence")
    assert rows["po_date"]["review_reason"] == "missing_required" and rows["po_date"]["confidence"] == 0.0
    assert rows["vendor.name"]["confidence"] == 0.95 and not rows["vendor.name"]["flagged"]
    assert rows["due_date"]["value"] is None and rows["due_date"]["confidence"] == 0.9
    assert rows["line_items"]["value_type"] == "array" and rows["line_items"]["confidence"] == 0.7
    assert rows["payment_terms"]["confidence"] == pytest.approx(0.58) and "sure" in rows["payment_terms"]["parse_note"]


def test_targets_limit_the_fields(spark):
    replies = spark.createDataFrame([(1, "{}"), (2, "{}")], "document_id int, raw_response string")
    targets = spark.createDataFrame([(1, ["po_number", "currency"])], "document_id int, field_paths array<string>")
    rows = R.reply_fields(R.clean_replies(replies), targets=targets).collect()
    assert sorted(r["field_path"] for r in rows) == ["currency", "po_number"]


def test_provider_failure_is_a_row(spark):
    def make():
        def call(prompt):
            if "bad" in prompt:
                raise ValueError("no")
            return "{}", 1, 2
        return call

    prompts = spark.createDataFrame([(1, "good"), (2, "bad")], "document_id long, prompt string")
    rows = {r["document_id"]: r for r in R.apply_provider(prompts, make, "local").collect()}
    assert rows[1]["error"] is None and rows[2]["error"] == "ValueError: no" and rows[2]["raw_response"] is None


FIELD = "document_id int, field_path string, value string, confidence double, source_model string"


def test_merge(spark):
    first = spark.createDataFrame([(1, "a", "x", 0.9, "local"), (1, "b", "12.50", 0.3, "local"), (1, "c", "old", 0.2, "local"),
                                   (1, "d", None, 0.0, "local")], FIELD)
    second = spark.createDataFrame([(1, "b", "1,250", 0.9, "groq"), (1, "c", "new", 0.9, "groq"), (1, "d", "found", 0.8, "groq"),
                                    (1, "e", "extra", 0.8, "groq")], FIELD)
    out = P.merge_passes(first, second)
    rows = {r["field_path"]: r for r in out.collect()}
    assert {k: r["value"] for k, r in rows.items()} == {"a": "x", "b": "1,250", "c": "new", "d": "found", "e": "extra"}
    assert [k for k, r in rows.items() if r["review_reason"] == "model_disagreement"] == ["c"]
    strict = {r["field_path"] for r in P.merge_passes(first, second, strict=True).collect() if r["disagrees"]}
    assert strict == {"b", "c"}
    again = P.merge_passes(out.drop("disagrees"), second)
    assert sorted(map(str, again.drop("disagrees", "flagged", "review_reason").collect())) == sorted(
        map(str, out.drop("disagrees", "flagged", "review_reason").collect()))


def test_routing(spark):
    docs = spark.createDataFrame([(1, 0.9, True, True), (2, 0.2, True, True), (3, 0.9, False, True), (4, 0.9, None, False)],
                                 "document_id int, quality double, local_ok boolean, remote_ok boolean")
    got = {r["document_id"]: (r["primary"], r["route_error"] is None) for r in P.choose_primary(docs).collect()}
    assert got == {1: ("local", True), 2: ("groq", True), 3: ("groq", True), 4: (None, False)}


def test_health_crosses_bucket_borders(spark):
    ts = lambda s: f"2024-01-01 00:00:{s:06.3f}"
    probes = spark.createDataFrame([("a", ts(29), True, 1), ("a", ts(29), False, 2), ("a", ts(45), True, 3)],
                                   "provider string, ts string, ok boolean, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = spark.createDataFrame([(1, "a", ts(31)), (2, "a", ts(29)), (3, "a", ts(10)), (4, "a", ts(59)), (5, "b", ts(31)), (6, "a", ts(45))],
                                  "document_id int, provider string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["document_id"]: (r["ok"], r["age_ms"]) for r in P.health_asof(asked, probes).collect()}
    assert got == {1: (False, 2000.0), 2: (False, 0.0), 3: (None, None), 4: (True, 14000.0), 5: (None, None), 6: (True, 0.0)}


def test_texts_are_bound_once(spark):
    """The fence is looked for once in a reply, and a value's words are cut once, however often the steps below use them."""
    replies = spark.createDataFrame([(1, '```json\n{"po_number": {"value": "a, b", "confidence": 1}}\n```')], "document_id int, raw_response string")
    cleaned = R.clean_replies(replies)
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("(?:json)") <= 2
    boosted = spark.createDataFrame([("acme tools", 0.5, "tools by acme")], "v string, c double, t string").select(
        R.evidence_boost(F.col("v"), F.col("c"), F.col("t")).alias("c"))
    assert boosted._jdf.queryExecution().optimizedPlan().toString().count("(?U)") == 1 and boosted.first()["c"] == 0.58
    assert cleaned.first()["reply_status"] == "clean"
