"""Exports of finished records: JSON, CSV, XML and a signed outbox.

All of them start from records built from corrected fields, so a reviewer's value
reaches every format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.constants import BUYER, LINE_ITEM, TOP_LEVEL, TOTALS, VENDOR
from ledgerlens.functions import numbers as N
from ledgerlens.functions.signing import hmac_sha256
from ledgerlens.operators.assemble import PO_COLUMNS, item_columns, item_texts
from ledgerlens.operators.frames import col_or_null, latest

#: keys of the JSON record around its items
BEFORE_ITEMS = PO_COLUMNS[:PO_COLUMNS.index("totals")]
AFTER_ITEMS = PO_COLUMNS[PO_COLUMNS.index("totals"):]
CSV_HEADER = {
    "po_number": "po_number", "po_date": "po_date", "due_date": "due_date", "payment_terms": "payment_terms",
    "delivery_terms": "delivery_terms", "currency": "currency", "vendor_name": "vendor_name",
    "vendor_address": "vendor_address", "vendor_city": "vendor_city", "vendor_country": "vendor_country",
    "vendor_email": "vendor_email", "vendor_phone": "vendor_phone", "vendor_tax_id": "vendor_tax_id",
    "buyer_name": "buyer_name", "buyer_department": "buyer_department", "buyer_contact_person": "buyer_contact_person",
    "total_subtotal": "subtotal", "total_tax": "tax_amount", "total_shipping": "shipping",
    "total_discount": "discount", "total_grand": "grand_total",
}
CSV_ITEM = {
    "line_number": None, "line_description": "description", "part_number": "part_number", "quantity": "quantity",
    "unit": "unit", "unit_price": "unit_price", "line_total": "line_total", "line_currency": "currency",
    "tax_rate": "tax_rate",
}
_NUMBERS = {"subtotal", "tax_amount", "shipping", "discount", "grand_total", "quantity", "unit_price", "line_total", "tax_rate"}
XML_NAMES = {
    "po_number": "PONumber", "po_date": "PODate", "due_date": "DueDate", "payment_terms": "PaymentTerms",
    "delivery_terms": "DeliveryTerms", "currency": "Currency", "tax_id": "TaxID",
}


number_text = N.plain_text


def export_name(po_number: Column, result_id: Column, fmt: str) -> Column:
    """Download name."""
    key = F.coalesce(F.nullif(po_number, F.lit("")), F.substring(result_id.cast("string"), 1, 8))
    return F.concat(F.lit("po_"), key, F.lit(f".{fmt}"))


# --- corrections ---------------------------------------------------------------------------

def apply_corrections(po: DataFrame, corrections: DataFrame) -> DataFrame:
    """Records (``assemble.build_po``) with the reviewers' latest value of every header field.

    ``corrections(document_id, field_path, corrected_value, seq)``: any top-level path or
    ``section.key``; a section that is absent is made. Items (``line_items.*``) are left out, and so are
    paths the record does not have. Corrections of documents without a record are dropped. Many
    corrections of one field are folded before they meet the record, one map for each document.
    """
    sections = {"vendor": VENDOR, "buyer": BUYER, "totals": TOTALS}
    paths = [*TOP_LEVEL, *[f"{s}.{k}" for s, keys in sections.items() for k in keys]]
    last = latest(corrections.select("document_id", "field_path", "corrected_value", "seq"), ["document_id", "field_path"], ["seq"])
    last = last.filter(F.col("field_path").isin(paths) & F.col("corrected_value").isNotNull())
    per_document = last.groupBy("document_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field_path", "corrected_value"))).alias("_fixed"))

    def value(path: str, had: Column, numeric: bool = False) -> Column:
        fixed = F.col("_fixed")[path]
        return F.coalesce(N.to_number(fixed) if numeric else fixed, had)

    made = {k: value(k, F.col(k)) for k in TOP_LEVEL}
    for name, keys in sections.items():
        fields = {k: value(f"{name}.{k}", F.col(name)[k], name == "totals" and k != "currency") for k in keys}
        any_present = F.col(name).isNotNull() | F.coalesce(*[F.col("_fixed")[f"{name}.{k}"] for k in keys]).isNotNull()
        made[name] = F.when(any_present, F.struct(*[c.alias(k) for k, c in fields.items()]))
    return po.join(per_document, "document_id", "left").withColumns(made).select(*po.columns)


# --- JSON ----------------------------------------------------------------------------------

def _members(keys: tuple[str, ...]) -> Column:
    """The members of a JSON object without its braces; empty where all are null."""
    text = F.to_json(F.struct(*keys))
    return F.nullif(F.substring(text, 2, F.length(text) - 2), F.lit(""))


def json_bodies(po: DataFrame, items: DataFrame, *more: Column) -> DataFrame:
    """``po`` with ``body``: the whole record as one JSON text, nulls left out; ``more`` are further members at its end."""
    texts = item_texts(items, F.to_json(F.struct(*item_columns(items))), separator=",").select("document_id", "items_text")
    listed = F.concat(F.lit('"line_items":['), F.coalesce("items_text", F.lit("")), F.lit("]"))
    body = F.concat(F.lit("{"), F.concat_ws(",", _members(BEFORE_ITEMS), listed, _members(AFTER_ITEMS), *more), F.lit("}"))
    return po.join(texts, "document_id", "left").withColumn("body", body).drop("items_text")


def export_json(po: DataFrame, items: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One JSON text per record, however many items it has.

    ``metadata`` (see :func:`json_metadata`) adds a ``_metadata`` block.
    """
    if metadata is None:
        return json_bodies(po, items).select("document_id", "body")
    known = po.join(metadata.select("document_id", "_metadata"), "document_id", "left")
    block = F.concat(F.lit('"_metadata":'), F.to_json("_metadata"))
    return json_bodies(known, items, block).select("document_id", "body")


def json_metadata(results: DataFrame, fields: DataFrame, exported_at) -> DataFrame:
    """Provenance block per document: ids, confidences, models, approval.

    Row pseudo fields (``line_items.N``) are left out; confidences have three decimals.
    ``results`` holds ``document_id, result_id, overall_confidence, primary_model,
    fallback_triggered, fallback_fields, processing_duration_ms, approved``.
    """
    real = fields.filter(F.col("value").isNotNull() & ~F.col("field_path").startswith("line_items."))
    entry = F.struct("value", F.round("confidence", 3).alias("confidence"), F.col("source_model").alias("source"))
    per_field = real.groupBy("document_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_path", entry)))).alias("field_confidence"))
    types = {"result_id": "string", "overall_confidence": "double", "primary_model": "string", "fallback_triggered": "boolean",
             "fallback_fields": "array<string>", "processing_duration_ms": "long", "approved": "boolean"}
    cols = {n: col_or_null(results, n, t) for n, t in types.items()}
    cols["overall_confidence"] = F.round(cols["overall_confidence"], 3)
    order = ["result_id", "document_id", "overall_confidence", "primary_model", "fallback_triggered", "fallback_fields",
             "processing_duration_ms", "exported_at", "approved", "field_confidence"]
    cols |= {"document_id": F.col("document_id").cast("string"), "exported_at": F.lit(exported_at).cast("string"),
             "field_confidence": F.col("field_confidence")}
    return results.join(per_field, "document_id", "left").select(
        "document_id", F.struct(*[cols[n].alias(n) for n in order]).alias("_metadata"))


# --- CSV -------------------------------------------------------------------------------------

def export_csv(header: DataFrame, items: DataFrame) -> DataFrame:
    """Denormalised rows: 21 header and 9 item columns, all text, empty for null.

    ``header`` is flat (``assemble.flat_header``), ``items`` one row per item: the
    items are joined, not gathered, so a long order is many rows and never one group.
    A record without items still gives one row. The line number defaults to the
    position (W4). ``document_id`` and ``pos`` come along for ordering.
    """
    def text(df: DataFrame, name: str) -> Column:
        c = col_or_null(df, name, "double" if name in _NUMBERS else "string")
        return F.coalesce(number_text(c) if name in _NUMBERS else c.cast("string"), F.lit(""))

    number = F.coalesce(F.nullif(col_or_null(items, "line_number", "int"), F.lit(0)), F.col("pos") + 1)
    rows = items.select(
        "document_id", "pos", number.cast("string").alias("line_number"),
        *[text(items, src).alias(out) for out, src in CSV_ITEM.items() if src])
    head = header.select("document_id", *[text(header, src).alias(out) for out, src in CSV_HEADER.items()])
    # items stand on the left, where a hot order can be split; records without items follow
    with_items = rows.join(head, "document_id")
    without = head.join(items.select("document_id"), "document_id", "left_anti")
    columns = ["document_id", "pos", *CSV_HEADER, *CSV_ITEM]
    return with_items.select(
        "document_id", "pos", *CSV_HEADER, *[F.coalesce(c, F.lit("")).alias(c) for c in CSV_ITEM],
    ).unionByName(without.withColumns({"pos": F.lit(-1), **{c: F.lit("") for c in CSV_ITEM}}).select(*columns))


def write_csv(rows: DataFrame, path: str, byte_order_mark: bool = False) -> None:
    """Write export rows in document order; quotes are doubled, lines end in CRLF.

    Ranges of (document, position) rather than whole documents go to a file, so a very
    long order is spread over several.
    """
    columns = [*CSV_HEADER, *CSV_ITEM]
    out = rows.repartitionByRange("document_id", "pos").sortWithinPartitions("document_id", "pos").select(*columns)
    if byte_order_mark:
        out = out.withColumnRenamed(columns[0], "﻿" + columns[0])
    out.write.mode("overwrite").option("header", "true").option("lineSep", "\r\n").option("quote", '"').option(
        "escape", '"').option("emptyValue", "").csv(path)


# --- XML --------------------------------------------------------------------------------------

def _camel(name: str) -> str:
    return XML_NAMES.get(name) or "".join(p.capitalize() for p in name.split("_"))


def export_xml(po: DataFrame, items: DataFrame, result_id: Column | None = None, generated_at: str | None = None) -> DataFrame:
    """One ``PurchaseOrder`` text per record, however many items it has (S9); null gives no element."""
    rid = result_id if result_id is not None else F.col("document_id")
    text = lambda c, n: number_text(c) if n in _NUMBERS else c.cast("string")

    def without(shown: Column, end: str) -> Column:
        return F.when(F.endswith(shown, F.lit(end)), F.substring(shown, F.lit(1), F.length(shown) - len(end))).otherwise(shown)

    def one_line(df: DataFrame, *names: str) -> DataFrame:
        # without indents a fragment is one line and a line break, and only values can hold more: blank ones that do become empty
        cut = df.withColumns({n: without(F.col(n), "\n") for n in names})
        clean = lambda c: F.when(F.contains(c, F.lit("\n")), F.regexp_replace(c, r">\s*\n\s*<", "><")).otherwise(c)
        return cut.withColumns({n: clean(F.col(n)) for n in names})

    # made as columns of their own, as each is used several times
    xml = lambda body, tag: F.to_xml(body, {"rowTag": tag, "indent": ""})

    def section(name: str, keys) -> Column:
        body = F.struct(*[text(F.col(f"{name}.{k}"), k).alias(_camel(k)) for k in keys])
        return F.when(F.col(name).isNotNull(), body).alias(_camel(name))

    columns = items.select("document_id", "pos", *item_columns(items))
    item = xml(F.struct(*[text(F.col(k), k).alias(_camel(k)) for k in LINE_ITEM]), "LineItem").alias("_item")
    # the item's own start tag takes its number
    numbered = lambda n, x: F.concat(F.lit('<LineItem index="'), n.cast("string"), x)
    shown = one_line(columns.select("document_id", "pos", item), "_item")
    texts = item_texts(shown, F.concat(F.lit('"'), F.substring("_item", 10, 1 << 30)), numbered)
    listed = F.when(F.col("items_count") > 0, F.concat(
        F.lit('<LineItems count="'), F.col("items_count").cast("string"), F.lit('">'), F.col("items_text"), F.lit("</LineItems>")))
    top = ("po_number", "po_date", "due_date", "payment_terms", "delivery_terms", "currency")
    header = F.struct(*[F.col(k).alias(_camel(k)) for k in top], section("vendor", VENDOR), section("buyer", BUYER)).alias("Header")
    totals = F.struct(*[text(F.col(f"totals.{k}"), k).alias(_camel(k)) for k in ("subtotal", "tax_amount", "shipping", "discount", "grand_total", "currency")])
    stamp = [F.lit(generated_at).alias("_generated_at")] if generated_at else []
    head = xml(F.struct(*stamp, rid.cast("string").alias("_result_id"), header), "PurchaseOrder")
    tail = F.when(F.col("totals").isNotNull(), xml(totals, "Totals"))
    joined = po.join(texts, "document_id", "left").select("document_id", head.alias("_head"), listed.alias("_listed"), tail.alias("_tail"))
    # the start with the header, then items and totals, then the end tag; totals without a value give no element
    cut = one_line(joined, "_head", "_tail").withColumn("_head", without(F.col("_head"), "</PurchaseOrder>"))
    open_ = F.when(F.endswith(F.col("_head"), F.lit("/>")), F.concat(without(F.col("_head"), "/>"), F.lit(">"))).otherwise(F.col("_head"))
    body = F.concat(open_, F.coalesce("_listed", F.lit("")),
                    F.when(F.startswith(F.col("_tail"), F.lit("<Totals>")), F.col("_tail")).otherwise(F.lit("")), F.lit("</PurchaseOrder>"))
    return cut.select("document_id", body.alias("body"))


# --- outbox -------------------------------------------------------------------------------------

def webhook_outbox(po: DataFrame, items: DataFrame, approvals: DataFrame, secret: str | None, at, event: str = "po.extracted") -> DataFrame:
    """One payload and signature per approved record.

    ``approvals`` holds the current decision per document; only approved ones pass.
    Delivery belongs to the caller's sink, e.g. a ``foreachBatch`` over this table.
    """
    approved = approvals.filter(F.col("status") == "approved").select("document_id")
    ready = json_bodies(po.join(approved, "document_id", "left_semi"), items.join(approved, "document_id", "left_semi"))
    rid = col_or_null(po, "result_id") if "result_id" in po.columns else F.col("document_id").cast("string")
    envelope = F.to_json(F.struct(
        F.lit(event).alias("event"), F.lit(at).cast("string").alias("timestamp"), rid.alias("result_id"),
        F.col("document_id").cast("string").alias("document_id")))
    payload = F.concat(F.regexp_replace(envelope, r"\}$", ""), F.lit(',"po_data":'), F.col("body"), F.lit(',"ready_for_processing":true}'))
    out = ready.select("document_id", payload.alias("payload"))
    signature = F.concat(F.lit("sha256="), hmac_sha256(F.col("payload"), secret)) if secret else F.lit(None).cast("string")
    return out.withColumn("signature", signature)


def write_bodies(exports: DataFrame, path: str, buckets: int = 64) -> None:
    """Write export texts keyed by id, in a fixed number of folders rather than one per id."""
    bucket = F.pmod(F.xxhash64(F.col("document_id").cast("string")), F.lit(buckets)).cast("int")
    exports.withColumn("bucket", bucket).repartition("bucket", "document_id").write.mode("overwrite").partitionBy(
        "bucket").parquet(path)
