"""Items, records, review and exports."""

import csv
import io
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import numbers as N
from ledgerlens.operators import assemble as A, jobs as J, lines as L, passes as P, review as V, rules as R
from ledgerlens.sinks import exports as E

FIELD = "document_id int, field_path string, value string, confidence double, source_model string, flagged boolean, review_reason string"
FIELDS = [
    (1, "po_number", " PO-1 ", 0.9, "local", False, None), (1, "currency", "EURO", 0.8, "local", False, None),
    (1, "vendor.name", "Acme", 0.6, "groq", True, "low_confidence"), (1, "totals.subtotal", "$1,234.50", 0.95, "local", False, None),
    (1, "totals.shipping", "n/a", 0.95, "local", False, None), (1, "ship_to", None, 0.0, "local", True, "missing_required"),
    (1, "additional_fields", '{"ship_via": "Rail"}', 0.9, "local", False, None), (2, "po_date", None, 0.0, "local", True, "missing_required"),
]


def fields(spark):
    return spark.createDataFrame(FIELDS, FIELD)


def test_item_parsing(spark):
    raws = [
        (1, '[{"description": "a", "quantity": "3", "unit_price": "$1,000.50"}, "x", {"description": ""}, {"quantity": 1}]'),
        (2, '{"description": {"value": "b", "confidence": 1}, "line_total": {"value": 5}, "part_number": 77}'),
        (3, '[{"description": "c", "quantity": "some", "tax_rate": 18}]'), (4, "not json"), (5, "[]"), (6, "7"), (7, None),
    ]
    parsed = A.parse_line_items(spark.createDataFrame(raws, "document_id int, raw string"))
    rows = {(r["document_id"], r["pos"]): r for r in parsed.collect()}
    assert (rows[1, 0]["quantity"], rows[1, 0]["unit_price"], rows[1, 0]["reject_reason"]) == (3.0, 1000.5, None)
    assert rows[1, 1]["reject_reason"] == "not an object"
    assert rows[1, 2]["reject_reason"] == rows[1, 3]["reject_reason"] == "missing description"
    assert (rows[2, 0]["description"], rows[2, 0]["line_total"], rows[2, 0]["part_number"]) == ("b", 5.0, "77")
    assert rows[3, 0]["reject_reason"] == "tax_rate is above one" and rows[3, 0]["unread_numbers"] == "quantity"
    assert rows[4, -1]["reject_reason"] == rows[7, -1]["reject_reason"] == "unreadable text"
    assert rows[6, -1]["reject_reason"] == "not a list"
    assert not any(d == 5 for d, _ in rows)
    assert A.accepted_items(parsed).count() + A.rejected_items(parsed).count() == len(rows)


def test_item_fields_are_read_in_one_step(spark):
    raws = [
        (1, '\n [{"description": {"value": null}, "notes": {"a": 1}, "unit": {"value": {"b": 2}}}, null, [], {"value": "x", "Description": "y"}]'),
        (2, '{"description": "a", "description": "b"}'), (3, '{"description": "c", "line_number": 1.50, "tax_rate": null, "unit": [1]} rest'), (4, "null"),
    ]
    parsed = A.parse_line_items(spark.createDataFrame(raws, "document_id int, raw string"))
    rows = {(r["document_id"], r["pos"]): r for r in parsed.collect()}
    assert (rows[1, 0]["description"], rows[1, 0]["notes"], rows[1, 0]["unit"]) == (None, '{"a":1}', '{"b":2}')
    assert [rows[1, i]["reject_reason"] for i in range(4)] == ["missing description", "not an object", "not an object", "missing description"]
    assert rows[2, -1]["reject_reason"] == rows[4, -1]["reject_reason"] == "unreadable text"
    assert (rows[3, 0]["reject_reason"], rows[3, 0]["unit"]) == ("line_number is not an integer", "[1]") and len(rows) == 7
    # the text is parsed once, and elements are read whole; looking each field up by its name took 20 steps more
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json(") + plan.count("parseJson(") == 1 and "from_json(" not in plan and "$.quantity" not in plan
    # fused steps that the JVM would not compile run apart
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_xml_is_written_without_indents(spark):
    """Blank values with a line break are empty, other line breaks stay; amounts are plain at any size."""
    po = A.build_po(spark.createDataFrame(
        [(1, "notes", "n", 0.9, "local"), (1, "vendor.name", "a\nb <&>", 0.9, "local"), (1, "totals.subtotal", "0.0005", 0.9, "local"), (1, "totals.shipping", "12345678.5", 0.9, "local")],
        "document_id int, field_path string, value string, confidence double, source_model string"))
    items = spark.createDataFrame([(1, 0, " \n ", 9999999.5), (1, 1, "x", 0.001), (1, 2, "y", 1e7)], "document_id int, pos int, description string, quantity double")
    out = E.export_xml(po, items)
    root = ET.fromstring(out.first()["body"])
    assert root.findtext("Header/Vendor/Name") == "a\nb <&>"
    assert (root.findtext("Totals/Subtotal"), root.findtext("Totals/Shipping")) == ("0.0005", "12345678.5")
    assert [(i.findtext("Description"), i.findtext("Quantity")) for i in root.iter("LineItem")] == [("", "9999999.5"), ("x", "0.001"), ("y", "10000000.0")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "to_xml((rowTag" not in plan and "regexp_extract(" not in plan


def test_record(spark):
    po = {r["document_id"]: r for r in A.build_po(fields(spark)).collect()}
    assert po[1]["po_number"] == "PO-1" and po[1]["currency"] is None and po[1]["buyer"] is None
    assert po[1]["vendor"]["name"] == "Acme" and po[1]["totals"]["subtotal"] == 1234.5 and po[1]["totals"]["shipping"] is None
    assert po[1]["additional_fields"] == {"ship_via": "Rail"}
    # nothing was read of document 2: its record is there, and empty
    assert all(v is None for k, v in po[2].asDict().items() if k != "document_id")


def test_flat_and_nested_agree(spark):
    po = A.build_po(fields(spark))
    again = A.nest_header(A.flat_header(po)).drop("additional_fields")
    assert [r.asDict(True) for r in again.collect()] == [r.asDict(True) for r in po.drop("additional_fields").collect()]


def test_long_orders_are_one_record(spark):
    po = A.build_po(fields(spark))
    items = spark.range(1500).repartition(7).select(F.lit(1).alias("document_id"), F.col("id").cast("int").alias("pos"), F.format_string("item %d", "id").alias("description"))
    for parts in (1, 5):
        some = items.repartition(parts)
        listed = json.loads(E.export_json(po, some).first()["body"])["line_items"]
        assert [i["description"] for i in listed] == [f"item {i}" for i in range(1500)]
        found = ET.fromstring(E.export_xml(po, some).first()["body"]).find("LineItems")
        assert found.get("count") == "1500" and [i.get("index") for i in found] == [str(i + 1) for i in range(1500)]
        decided = spark.createDataFrame([(1, "approved")], "document_id int, status string")
        payload = E.webhook_outbox(po, some, decided, "s", "t").collect()
        assert len(payload) == 1 and len(json.loads(payload[0]["payload"])["po_data"]["line_items"]) == 1500
        blocks = A.item_texts(some, F.col("description"), lambda n, x: F.concat(n.cast("string"), F.lit("="), x), ",", per_block=10).first()
        assert blocks["items_count"] == 1500 and blocks["items_text"].split(",")[999] == "1000=item 999"


def test_amounts_that_no_decimal_holds(spark):
    raw = [(i, json.dumps([{"description": "x", "line_total": v}])) for i, v in enumerate(["1e19", "1e23", "1e400", "1e-11", "-2.5E8", "0"])]
    items = A.parse_line_items(spark.createDataFrame(raw, "document_id int, raw string"))
    got = {r["document_id"]: (r["line_total"], r["unread_numbers"]) for r in items.collect()}
    assert got[0] == (1e19, None) and got[1][0] == pytest.approx(1e23) and got[2] == (None, "line_total") and got[3] == (1e-11, None) and got[5] == (0.0, None)
    assert items.filter("document_id = 4").first()["reject_reason"] == "line_total is negative"
    po = A.build_po(spark.createDataFrame([(i, "totals.subtotal", v) for i, v in enumerate(["1e19", "1e23", "1e400", "1e-11"])], "document_id int, field_path string, value string"))
    assert R.validate(A.flat_header(po), items, "2024-01-01").count() > 0
    csv_rows = {r["document_id"]: r["total_subtotal"] for r in E.export_csv(A.flat_header(po), items).collect()}
    assert csv_rows[0] == "10000000000000000000.0" and csv_rows[2] == "" and csv_rows[3] == "0.00000000001"
    assert "E" not in csv_rows[1] and float(csv_rows[1]) == pytest.approx(1e23)
    assert E.export_json(po, items).count() == E.export_xml(po, items).count() == po.count()
    shown = spark.sql("select explode(array(1.2345e7, -1.5e-4, 123.25, 1e7, cast('NaN' as double), 0.1, 9.87654321e12)) x").select(N.plain_text(F.col("x").cast("double")).alias("t"))
    assert [r["t"] for r in shown.collect()] == ["12345000.0", "-0.00015", "123.25", "10000000.0", None, "0.1", "9876543210000.0"]
    total = spark.sql("select explode(array(1e23d, 0.1d, 0.2d, cast(null as double))) x").agg(N.exact_sum(F.col("x")).alias("s")).first()["s"]
    assert total == 1e23 + 0.3


def test_corrections_reach_every_section(spark):
    po = A.build_po(fields(spark))
    fixes = spark.createDataFrame(
        [(1, "vendor.name", "Old", 1), (1, "vendor.name", "New Ltd", 2), (1, "ship_to", "Dock 4", 3), (1, "buyer.name", "Beth", 4), (1, "totals.tax_amount", "$1,200.50", 5),
         (1, "line_items.0.quantity", "7", 6), (1, "nothing.here", "x", 7), (9, "ship_to", "y", 8), (1, "currency", "EUR", 9)],
        "document_id int, field_path string, corrected_value string, seq long")
    out = E.apply_corrections(po, fixes)
    assert out.columns == po.columns and out.count() == po.count()
    row = out.filter("document_id = 1").first()
    assert (row["vendor"]["name"], row["ship_to"], row["buyer"]["name"], row["totals"]["tax_amount"], row["currency"]) == ("New Ltd", "Dock 4", "Beth", 1200.5, "EUR")
    assert row["totals"]["subtotal"] == 1234.5
    body = json.loads(E.export_json(out.filter("document_id = 1"), spark.createDataFrame([], "document_id int, pos int")).first()["body"])
    assert body["ship_to"] == "Dock 4" and body["vendor"]["name"] == "New Ltd" and body["line_items"] == []


def test_costs_keep_every_error_in_order(spark):
    calls = spark.createDataFrame([(1, 3, "fallback", 5, None, 1, "b"), (1, 1, "primary", 1, 2, None, "b"), (1, 2, "primary", 1, 2, 3, "a"), (2, 1, "primary", 1, 1, 1, None)],
                                  "document_id int, seq int, pass string, latency_ms int, prompt_tokens int, completion_tokens int, parse_error string")
    got = {r["document_id"]: (r["passes"], r["parse_errors"], r["latency_ms"]) for r in P.pass_costs(calls).collect()}
    assert got == {1: ("primary+fallback", "b; a; b", 7), 2: ("primary", "", 1)}


def test_scores(spark):
    flags = spark.createDataFrame([(1, "error", ["totals.subtotal", "line_items"]), (1, "warning", ["po_date"])],
                                  "document_id int, severity string, affected_fields array<string>")
    got = {r[0]: r[1] for r in A.overall_confidence(fields(spark)).collect()}
    assert got == {1: 0.6, 2: 0.0}
    listed = {r[0]: r[1] for r in A.flagged_fields(fields(spark), flags).collect()}
    assert listed == {1: ["line_items", "ship_to", "totals.subtotal", "vendor.name"], 2: ["po_date"]}
    assert set(A.field_map(fields(spark)).filter("document_id = 2").first()["fields"]) == {"po_date"}


def test_corrections(spark):
    fixes = spark.createDataFrame([(1, "vendor.name", "Old", "r", 1), (1, "vendor.name", "Acme Ltd", "r", 2), (2, "notes", "new", "r", 3), (9, "x", "y", "r", 4)],
                                  "document_id int, field_path string, corrected_value string, reviewer_id string, seq long")
    known = fixes.filter("document_id < 9")
    once = V.apply_corrections(fields(spark), known)
    rows = {(r["document_id"], r["field_path"]): r for r in once.collect()}
    assert (rows[1, "vendor.name"]["value"], rows[1, "vendor.name"]["confidence"], rows[1, "vendor.name"]["source_model"],
            rows[1, "vendor.name"]["flagged"], rows[1, "vendor.name"]["review_reason"]) == ("Acme Ltd", 1.0, "human", False, None)
    assert rows[2, "notes"]["value"] == "new" and rows[1, "ship_to"]["flagged"]
    twice = V.apply_corrections(once, known)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    assert [r["document_id"] for r in V.unknown_corrections(fixes, fields(spark)).collect()] == [9]
    pairs = {r["seq"]: (r["original_value"], r["original_source"]) for r in V.correction_history(fields(spark), known).collect()}
    assert pairs == {1: ("Acme", "groq"), 2: ("Old", "human"), 3: (None, None)}
    assert {r[0]: r[1] for r in A.overall_confidence(once).collect()}[1] == 0.8


def test_approvals(spark):
    approved = spark.createDataFrame([(1, None), (2, "po_date"), (2, "absent")], "document_id int, field_path string")
    out = V.approve_fields(fields(spark), approved)
    assert out.filter("flagged").count() == 0
    human = {(r["document_id"], r["field_path"]) for r in out.filter("source_model = 'human'").collect()}
    assert human == {(1, "vendor.name"), (1, "ship_to"), (2, "po_date")}
    left = V.remaining_flags(fields(spark).filter("flagged").select("document_id", "field_path"), out)
    assert {r["document_id"]: r["all_cleared"] for r in left.collect()} == {1: True, 2: True}


def test_gate(spark):
    results = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, None)], "document_id int, fields_flagged array<string>")
    decided = spark.createDataFrame([(1, "rejected", 1), (1, "approved", 2), (2, "rejected", 1)], "document_id int, status string, seq long")
    flags = spark.createDataFrame([(2, "error", "line_item.x:3"), (1, "error", "y")], "document_id int, severity string, rule string")
    got = {r["document_id"]: (r["ready"], r["pending_fields"], r["error_rules"]) for r in V.export_gate(results, decided, flags).collect()}
    assert got == {1: (True, [], []), 2: (False, ["b"], ["line_item.x"]), 3: (False, [], [])}
    assert V.export_gate(results, decided, flags, force=True).filter("ready").count() == 3


def record(spark):
    po = A.build_po(fields(spark)).filter("document_id = 1")
    items = spark.createDataFrame([(1, 0, 'Say "hi", ok', 2.0, 12345678.5, None), (1, 1, "plain <b>", 1.0, 0.5, 9)],
                                  "document_id int, pos int, description string, quantity double, unit_price double, line_number int")
    return po, items


def test_json(spark):
    po, items = record(spark)
    body = json.loads(E.export_json(po, items).first()["body"])
    assert body["line_items"][0] == {"description": 'Say "hi", ok', "quantity": 2.0, "unit_price": 12345678.5}
    assert "buyer" not in body and "currency" not in body and body["totals"] == {"subtotal": 1234.5}
    results = spark.createDataFrame([(1, "r-1", 0.12345, True)], "document_id int, result_id string, overall_confidence double, approved boolean")
    pseudo = fields(spark).union(spark.createDataFrame([(1, "line_items.0", "x", 0.92, "local", False, None)], FIELD))
    with_meta = json.loads(E.export_json(po, items, E.json_metadata(results, pseudo, "2024-01-01T00:00:00Z")).first()["body"])
    meta = with_meta["_metadata"]
    assert meta["overall_confidence"] == 0.123 and meta["result_id"] == "r-1" and meta["approved"] is True
    assert meta["field_confidence"]["vendor.name"] == {"value": "Acme", "confidence": 0.6, "source": "groq"}
    assert "line_items.0" not in meta["field_confidence"] and "ship_to" not in meta["field_confidence"]


def test_csv(spark, tmp_path):
    po, items = record(spark)
    rows = E.export_csv(A.flat_header(po), items)
    E.write_csv(rows, str(tmp_path / "out"), byte_order_mark=True)
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*.csv")))
    assert text.startswith("﻿po_number") and "\r\n" in text
    back = list(csv.DictReader(io.StringIO(text.lstrip("﻿"), newline="")))
    assert [r["line_description"] for r in back] == ['Say "hi", ok', "plain <b>"]
    assert [r["line_number"] for r in back] == ["1", "9"] and back[0]["unit_price"] == "12345678.5"
    assert back[0]["total_subtotal"] == "1234.5" and back[0]["buyer_name"] == ""
    empty = E.export_csv(A.flat_header(po), items.filter("pos > 5")).collect()
    assert len(empty) == 1 and empty[0]["line_number"] == ""


def test_xml(spark):
    po, items = record(spark)
    root = ET.fromstring(E.export_xml(po, items, generated_at="2024-01-01").first()["body"])
    assert root.tag == "PurchaseOrder" and root.get("result_id") == "1" and root.get("generated_at") == "2024-01-01"
    assert root.find("Header/PONumber").text == "PO-1" and root.find("Header/Currency") is None and root.find("Header/Buyer") is None
    found = root.find("LineItems")
    assert found.get("count") == "2" and [i.get("index") for i in found] == ["1", "2"]
    assert found[0].find("UnitPrice").text == "12345678.5" and found[1].find("Description").text == "plain <b>"
    assert root.find("Totals/Subtotal").text == "1234.5"


def test_outbox_takes_approved_only(spark):
    po, items = record(spark)
    decided = spark.createDataFrame([(1, "approved"), (2, "rejected")], "document_id int, status string")
    row = E.webhook_outbox(po, items, decided, "s", "2024-01-01T00:00:00Z").first()
    assert json.loads(row["payload"])["po_data"]["po_number"] == "PO-1" and row["signature"].startswith("sha256=")
    assert E.webhook_outbox(po, items, decided.filter("status = 'rejected'"), "s", "x").count() == 0
    assert E.webhook_outbox(po, items, decided, None, "x").first()["signature"] is None


def test_transitions_across_buckets(spark):
    rows = [(j, s, f"2024-01-0{1 + s // 3} 0{s % 3}:00:00", ("pending", "processing", "complete")[s % 3]) for j in (1, 2) for s in range(9)]
    events = spark.createDataFrame(rows, "job_id int, seq int, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted((r["job_id"], r["seq"], r["previous_status"], r["next_status"]) for r in J.job_transitions(events).collect())
    want = [(j, s, rows[s - 1][3] if s else None, rows[s + 1][3] if s < 8 else None) for j in (1, 2) for s in range(9)]
    assert got == want


def test_first_element_wins_on_half_even_rounding(spark):
    e = spark.createDataFrame([(1, 1, 0, "a", 0.5, 0.0), (1, 1, 1, "a", 0.4, 0.0), (1, 1, 2, "a", 1.5, 0.0), (1, 1, 3, "a", 2.5, 0.0)],
                              "document_id int, page int, seq int, text string, x0 double, y0 double")
    assert sorted(r["seq"] for r in L.dedupe_elements(e, ["seq"]).collect()) == [0, 2]


def test_pages_and_quality(spark):
    lines = spark.createDataFrame([(1, 1, 0, "a", 0.5), (1, 1, 1, "b", 0.6), (1, 2, 2, "c", 0.7)], "document_id int, page int, line_idx int, text string, ocr_confidence double")
    pages = spark.createDataFrame([(1, 1, "own"), (1, 2, ""), (2, 1, None)], "document_id int, page int, embedded_text string")
    got = {r[0]: r[1] for r in L.document_text(lines, pages).collect()}
    assert got == {1: "own\fc", 2: ""}
    assert {r[0]: r[1] for r in L.doc_quality(pages.select("document_id").distinct(), lines).collect()} == {1: 0.6, 2: 0.5}
    boxes = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 1), (1.0, 0.0, 1.0, 1.0, 1), (None, 0.0, 1.0, 1.0, 1)], "x0 double, y0 double, x1 double, y1 double, page int")
    assert L.valid_boxes(boxes).count() == 1 and L.rejected_boxes(boxes).count() == 2


def test_documents_without_a_value_have_a_result(spark):
    """Nothing could be read of document 2, and 3 has a flag besides: both are what a reviewer has to see."""
    fields = spark.createDataFrame(
        [(1, "po_number", "PO-1", 0.9, "local", False), (2, "po_number", None, 0.0, "local", True), (2, "vendor.name", None, 0.0, "local", True),
         (3, "po_number", None, 0.0, "local", False)],
        "document_id int, field_path string, value string, confidence double, source_model string, flagged boolean")
    flags = spark.createDataFrame([(2, 1, "missing", "error", "no number", ["po_number"]), (3, 1, "missing", "error", "no number", ["po_number"])],
                                  "document_id int, rule_order int, rule string, severity string, message string, affected_fields array<string>")
    rows = {r["document_id"]: r for r in A.assemble_results(fields, flags).collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[2]["po_number"], rows[2]["vendor"], rows[2]["overall_confidence"], rows[2]["errors"], rows[2]["fields_flagged"]) == (
        None, None, 0.0, 1, ["po_number", "vendor.name"])
    assert len(rows[2]["fields"]) == 2 and rows[3]["fields_flagged"] == ["po_number"]
    po = A.build_po(fields)
    assert sorted(r["document_id"] for r in po.collect()) == [1, 2, 3]
    fixes = spark.createDataFrame([(2, "po_number", "PO-2", 1)], "document_id int, field_path string, corrected_value string, seq int")
    fixed = {r["document_id"]: r["po_number"] for r in E.apply_corrections(po, fixes).collect()}
    assert fixed == {1: "PO-1", 2: "PO-2", 3: None}
