"""One hand-written row per rule branch."""

from pyspark.sql import functions as F

from ledgerlens.operators import rules as R

PO = "document_id int, po_number string, po_date string, due_date string, payment_terms string, currency string, " \
     "vendor_name string, vendor_email string, buyer_email string, subtotal double, tax_amount double, shipping double, " \
     "discount double, grand_total double, totals_currency string, flagged_fields array<string>"
GOOD = dict(po_number="P1", po_date="2024-01-01", due_date="2024-02-01", payment_terms="Net 30", currency="USD", vendor_name="V",
            vendor_email="a@b.co", buyer_email=None, subtotal=100.0, tax_amount=None, shipping=None, discount=None,
            grand_total=100.0, totals_currency="usd", flagged_fields=[])
ITEM = "document_id int, pos int, description string, quantity double, unit_price double, line_total double, currency string, tax_rate double"


def raised(spark, change=None, items=((0, "x", 2.0, 50.0, 100.0, "USD", None),), as_of="2024-06-01", **kw):
    row = {**GOOD, **(change or {})}
    po = spark.createDataFrame([(1, *[row[c.split()[0]] for c in PO.split(", ")[1:]])], PO)
    frame = spark.createDataFrame([(1, *i) for i in items], ITEM)
    rows = R.validate(po, frame, as_of, **kw).orderBy("rule_order", "rule").collect()
    return [(r["rule"], r["severity"]) for r in rows]


def test_clean_record(spark):
    assert raised(spark) == []


def test_presence(spark):
    got = raised(spark, dict(po_number=" ", vendor_name=None, po_date=None, grand_total=None))
    assert got == [("required_field_missing:po_number", "error"), ("required_field_missing:vendor.name", "error"),
                   ("expected_field_missing:po_date", "warning"), ("expected_field_missing:totals.grand_total", "warning"),
                   ("format.po_number_no_alphanumeric", "error")]


def test_held_field_has_its_own_message(spark):
    po = spark.createDataFrame([(1, None, ["po_number"]), (2, None, None)], "document_id int, po_number string, flagged_fields array<string>")
    got = {r["document_id"]: r["message"] for r in R.header_flags(po, None, "2024-01-01", ["required_fields"])
           .filter("rule = 'required_field_missing:po_number'").collect()}
    assert "review" in got[1] and "absent" in got[2]


def test_totals(spark):
    assert raised(spark, dict(subtotal=200.0, grand_total=200.0)) == [("totals.line_items_sum_mismatch", "error")]
    assert raised(spark, dict(grand_total=50.0)) == [("totals.grand_total_mismatch", "warning")]
    assert raised(spark, dict(grand_total=50.1234)) == [("totals.grand_total_mismatch", "error")]
    assert raised(spark, dict(grand_total=50.1234, payment_terms="Balance Due")) == [("totals.grand_total_mismatch", "warning")]
    assert raised(spark, dict(tax_amount=10.0, shipping=5.0, discount=15.0)) == []


def test_items(spark):
    assert raised(spark, dict(subtotal=None), items=()) == [("line_items.empty", "warning")]
    got = raised(spark, items=((0, "x", 2.0, 50.0, 100.0, "USD", None), (1, "y", 3.0, 50.0, 100.0, "USD", None)), change=dict(subtotal=200.0, grand_total=200.0))
    assert got == [("line_item.total_mismatch:1", "warning")]


def test_dates(spark):
    assert raised(spark, dict(due_date="2023-12-31")) == [("date.due_before_po", "error")]
    assert raised(spark, dict(po_date="Jan 1", due_date="soon")) == [
        ("date.po_date_invalid_format", "warning"), ("date.due_date_invalid_format", "warning")]
    assert raised(spark, dict(po_date="2026-01-01", due_date=None)) == [("date.po_date_far_future", "warning")]
    assert raised(spark, dict(po_date="2010-01-01")) == [("date.po_date_far_past", "warning")]


def test_currency_and_formats(spark):
    assert raised(spark, dict(totals_currency="EUR")) == [("currency.inconsistent", "warning")]
    assert raised(spark, dict(vendor_email="x", buyer_email="y")) == [
        ("format.invalid_email:vendor.email", "warning"), ("format.invalid_email:buyer.email", "warning")]


def test_own_rule(spark):
    def big(as_of):
        return [R.Flag(F.col("grand_total") > 10, "mine.big", "warning", F.lit("big"), ["totals.grand_total"])]

    assert raised(spark, rules={**R.HEADER_RULES, "big": big}) == [("mine.big", "warning")]


def test_constraints(spark):
    items = spark.createDataFrame([(1, 0, "d", -1.0, 1.0, 1.0, "EURO", 18.0), (1, 1, "", 1.0, 1.0, 1.0, "EUR", 0.1)], ITEM)
    got = sorted((r["pos"], r["reason"]) for r in R.item_violations(items).collect())
    assert got == [(0, "currency is not three characters"), (0, "quantity is negative"), (0, "tax_rate is above one"), (1, "description is missing")]
    fields = spark.createDataFrame([(1, "a", 1.2, False, None), (1, "b", 0.5, True, None), (1, "c", 0.5, True, "low_confidence")],
                                   "document_id int, field_path string, confidence double, flagged boolean, review_reason string")
    assert R.field_violations(fields).count() == 2
