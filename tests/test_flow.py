"""Raw replies to results in one plan."""

import json

from ledgerlens.operators import flow
from ledgerlens.sinks import exports as E

FIELDS = "document_id long, field_path string, value string, confidence double, source_model string, flagged boolean, review_reason string"
ITEMS = ("document_id long, pos int, description string, part_number string, quantity double, unit_price double, "
         "currency string, line_total double, tax_rate double")


def run(spark, replies, second=(), items=()):
    raw = spark.createDataFrame(replies, "document_id long, raw_response string")
    texts = spark.createDataFrame([(i, "Order PO-1 from Acme") for i, _ in replies], "document_id long, ocr_text string")
    return flow.extract(raw, texts, spark.createDataFrame(list(second), FIELDS), spark.createDataFrame(list(items), ITEMS), "2024-06-01")


def test_every_reply_has_a_result(spark):
    good = '{"po_number": {"value": "PO-1", "confidence": 0.9}, "vendor.name": {"value": "Acme", "confidence": 0.5}}'
    replies = [(1, good), (2, "no object at all"), (3, None), (4, "")]
    fields, results = run(spark, replies)
    rows = {r.document_id: r for r in results.collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[1].po_number == "PO-1" and rows[1].vendor.name == "Acme" and rows[1].line_items == "[]"
    assert all(rows[i].po_number is None and rows[i].overall_confidence == 0 and rows[i].errors >= 2 for i in (2, 3, 4))
    assert "required_field_missing:vendor.name" in {f.rule for f in rows[2].flags}
    assert fields.where("document_id = 3 and value is not null").count() == 0


def test_second_pass_only_where_it_was_asked(spark):
    reply = '{"po_number": {"value": "PO-1", "confidence": 0.9}, "vendor.name": {"value": "Acne", "confidence": 0.1}}'
    second = [(1, p, v, c, "groq", False, None) for p, v, c in (("po_number", "PO-2", 0.99), ("vendor.name", "Acme", 0.95))]
    second.append((9, "po_number", "PO-9", 0.9, "groq", False, None))
    fields, results = run(spark, [(1, reply)], second, [(1, 0, "bolt", None, 2.0, 3.0, None, 7.0, None), (9, 0, "nut", None, 1.0, 1.0, None, 9.0, None)])
    r = results.collect()
    assert [x.document_id for x in r] == [1]
    assert r[0].po_number == "PO-1" and r[0].vendor.name == "Acme" and r[0].fields["vendor.name"]["source"] == "groq"
    assert [x["description"] for x in json.loads(r[0].line_items)] == ["bolt"]
    assert "line_item.total_mismatch:0" in {f.rule for f in r[0].flags}
    clash = {x.field_path: x.review_reason for x in fields.where("disagrees").collect()}
    assert clash == {"vendor.name": "model_disagreement"}


def test_nothing_to_extract(spark):
    fields, results = run(spark, [(1, "{}")])
    assert flow.second_looks(fields.limit(0), fields).count() == 0
    raw = spark.createDataFrame([], "document_id long, raw_response string")
    texts = spark.createDataFrame([], "document_id long, ocr_text string")
    fields, results = flow.extract(raw, texts, spark.createDataFrame([], FIELDS), spark.createDataFrame([], ITEMS), "2024-06-01")
    assert fields.count() == 0 and results.count() == 0


def test_metadata_is_a_member_of_any_body(spark):
    """Bodies that end in braces inside a text, and records without metadata, stay as they are."""
    from ledgerlens.operators import assemble as A

    po = A.nest_header(spark.createDataFrame([(1, "PO}"), (2, "PO-2")], "document_id long, po_number string"))
    meta = spark.createDataFrame([(1, ("r1",))], "document_id long, _metadata struct<result_id:string>")
    items = spark.createDataFrame([], ITEMS)
    got = {r.document_id: json.loads(r.body) for r in E.export_json(po, items, meta).collect()}
    assert got == {1: {"po_number": "PO}", "line_items": [], "_metadata": {"result_id": "r1"}}, 2: {"po_number": "PO-2", "line_items": []}}
