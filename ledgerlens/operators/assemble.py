"""Field rows to purchase-order records and result rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlens.constants import BUYER, LINE_ITEM, TOP_LEVEL, TOTALS, VENDOR
from ledgerlens.functions import numbers as N, text as T
from ledgerlens.operators.frames import col_or_null, spread

ITEM_SCHEMA = (
    "line_number int, description string, part_number string, quantity double, unit string, "
    "unit_price double, currency string, line_total double, tax_rate double, notes string"
)
#: order of the record's keys
PO_COLUMNS = (
    "po_number", "po_date", "due_date", "required_by", "payment_terms", "payment_method", "delivery_terms",
    "currency", "authorized_by", "special_instructions", "vendor", "buyer", "ship_to", "totals", "notes",
    "document_language", "additional_fields",
)
#: positions whose items are put together before a document is
ITEMS_PER_BLOCK = 1000


# --- line items (P12, P13) ---------------------------------------------------------------

def parse_line_items(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Item arrays of model replies to item rows.

    An array, a single object and an array of ``{value, confidence}`` wrappers are all
    accepted. Every element gives one row; ``reject_reason`` is null on good ones, so
    accepted plus rejected rows equal the elements. Unreadable text gives one row with
    ``pos`` -1. Other columns of ``raw`` are kept.
    """
    keys = [c for c in raw.columns if c != column]
    # parsing costs far more than the bytes tell
    parsed = spread(raw, *[c for c in ("document_id", column) if c in raw.columns]).withColumn("_v", F.try_parse_json(F.col(column)))
    # text that parses tells its kind by its first character
    first = F.substring(F.ltrim(F.col(column), F.lit(" \t\n\r")), 1, 1)
    kind = F.when(F.col("_v").isNull() | (first == "n"), F.lit("null")).when(first == "[", F.lit("array")).when(first == "{", F.lit("object"))
    parsed = parsed.withColumn("_kind", F.coalesce(kind, F.lit("scalar")))

    def elements(of: str) -> Column:
        # all fields of an element in one step: a lookup of a key that is missing costs more than everything else here
        fields = f"struct<{', '.join(f'{n} {of}' for n in LINE_ITEM)}>"
        return F.when(F.col("_kind") == "array", F.try_variant_get("_v", "$", f"array<{fields}>")).when(
            F.col("_kind") == "object", F.array(F.try_variant_get("_v", "$", fields)))

    # one look at the text spares ordinary items the second step
    wrapped = F.when(F.contains(F.col(column), F.lit('"value"')), elements("struct<value variant>")).alias("_wrapped")
    rows = parsed.select(*keys, "_kind", wrapped, F.posexplode_outer(elements("string")).alias("_pos", "_e"))

    def part(name: str) -> Column:
        inside = F.get("_wrapped", F.col("_pos"))[name]["value"]
        return F.when(inside.isNotNull(), F.try_variant_get(inside, "$", "string")).otherwise(F.col("_e")[name])

    numbers = ("quantity", "unit_price", "line_total", "tax_rate")
    texts = ("description", "part_number", "unit", "currency", "notes")
    rows = rows.withColumns(
        {f"_{n}": part(n) for n in (*numbers, *texts, "line_number")})
    out = rows.withColumns(
        {n: N.to_number(F.col(f"_{n}")) for n in numbers}
        | {n: F.col(f"_{n}") for n in texts}
        | {"line_number": F.when(F.col("_line_number").rlike(r"^[+-]?\d{1,9}$"), F.col("_line_number").try_cast("int"))})
    reasons = [
        F.when(F.col("_kind") == "null", F.lit("unreadable text")),
        F.when(~F.col("_kind").isin("array", "object"), F.lit("not a list")),
        F.when(F.col("_e").isNull(), F.lit("not an object")),
        F.when(F.coalesce(F.col("description"), F.lit("")) == "", F.lit("missing description")),
        *[F.when(F.col(n) < 0, F.lit(f"{n} is negative")) for n in numbers],
        F.when(F.col("tax_rate") > 1, F.lit("tax_rate is above one")),
        F.when(F.length("currency") != 3, F.lit("currency is not three characters")),
        F.when(F.col("_line_number").isNotNull() & F.col("line_number").isNull(), F.lit("line_number is not an integer")),
    ]
    unread = F.concat_ws(", ", *[F.when(F.col(f"_{n}").isNotNull() & F.col(n).isNull(), F.lit(n)) for n in numbers])
    # an empty array has no element and gives no row
    return out.filter(F.col("_pos").isNotNull() | ~F.col("_kind").isin("array", "object")).select(
        *keys, F.coalesce("_pos", F.lit(-1)).alias("pos"), *LINE_ITEM,
        F.coalesce(*reasons).alias("reject_reason"), F.nullif(unread, F.lit("")).alias("unread_numbers"))


def accepted_items(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason", "unread_numbers")


def rejected_items(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNotNull())


# --- record (P14, A9) ----------------------------------------------------------------------

def record_values() -> list[Column]:
    """Aggregates that pick the record's values out of a document's field rows."""
    paths = [*TOP_LEVEL, *[f"vendor.{k}" for k in VENDOR], *[f"buyer.{k}" for k in BUYER],
             *[f"totals.{k}" for k in TOTALS], "additional_fields"]
    return [F.max(F.when(F.col("field_path") == p, F.col("value"))).alias(p.replace(".", "__")) for p in paths]


def record_of(wide: DataFrame, *also: str) -> DataFrame:
    """The nested record of picked values; ``also`` names further columns to keep.

    A section none of whose fields is present stays null. A document currency that is
    not three characters is nulled alone (see ``rules.header_violations``).
    """
    def section(name: str, keys: tuple[str, ...], numeric: bool = False) -> Column:
        cols = {k: F.col(f"{name}__{k}") for k in keys}
        made = {k: N.to_number(c) if numeric and k != "currency" else T.clean_string(c) for k, c in cols.items()}
        any_present = F.coalesce(*cols.values()).isNotNull()
        return F.when(any_present, F.struct(*[c.alias(k) for k, c in made.items()])).alias(name)

    top = {k: T.clean_string(F.col(k)) for k in TOP_LEVEL}
    top["currency"] = F.when(F.length(top["currency"]) == 3, top["currency"])
    nested = wide.select(
        "document_id", *[c.alias(k) for k, c in top.items()],
        section("vendor", VENDOR), section("buyer", BUYER), section("totals", TOTALS, numeric=True),
        F.from_json("additional_fields", "map<string,string>").alias("additional_fields"), *also)
    return nested.select("document_id", *PO_COLUMNS, *also)


def build_po(fields: DataFrame) -> DataFrame:
    """Pivot field rows into the nested record, without items: one shuffle on the document.

    A document whose fields are all empty has an empty record: reviewers correct it, so it must not get lost.
    """
    return record_of(fields.groupBy("document_id").agg(*record_values()))


def flat_header(po: DataFrame, *also: Column) -> DataFrame:
    """The record's header as the flat columns the rules and the CSV sink read; ``also`` are further columns."""
    plain = [c for c in PO_COLUMNS if c not in ("vendor", "buyer", "totals", "additional_fields")]
    totals = {k: ("totals_currency" if k == "currency" else k) for k in TOTALS}
    return po.select(
        "document_id", *plain, *[F.col(f"vendor.{k}").alias(f"vendor_{k}") for k in VENDOR],
        *[F.col(f"buyer.{k}").alias(f"buyer_{k}") for k in BUYER],
        *[F.col(f"totals.{k}").alias(n) for k, n in totals.items()], *also)


def nest_header(flat: DataFrame) -> DataFrame:
    """Inverse of :func:`flat_header`; columns that are missing become null."""
    def section(prefix: str, keys: tuple[str, ...], dtype: str) -> Column:
        cols = []
        for k in keys:
            name = f"vendor_{k}" if prefix == "vendor" else f"buyer_{k}" if prefix == "buyer" else (
                "totals_currency" if k == "currency" else k)
            cols.append(col_or_null(flat, name, "string" if k == "currency" else dtype).alias(k))
        return F.when(F.coalesce(*[c.cast("string") for c in cols]).isNotNull(), F.struct(*cols)).alias(prefix)

    plain = [col_or_null(flat, c).alias(c) for c in PO_COLUMNS if c not in ("vendor", "buyer", "totals", "additional_fields")]
    return flat.select(
        "document_id", *plain, section("vendor", VENDOR, "string"), section("buyer", BUYER, "string"),
        section("totals", TOTALS, "double"), col_or_null(flat, "additional_fields", "map<string,string>").alias("additional_fields"),
    ).select("document_id", *PO_COLUMNS)


def item_columns(items: DataFrame) -> list[Column]:
    """The item columns in order, missing ones as typed nulls."""
    return [col_or_null(items, c, t.split()[1]).cast(t.split()[1]).alias(c) for c, t in zip(LINE_ITEM, ITEM_SCHEMA.split(", "))]


def item_texts(items: DataFrame, text: Column, numbered: Callable[[Column, Column], Column] | None = None,
               separator: str = "", per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """One text of all items per document in order of ``pos``, and their count (A10).

    ``text`` renders one item; ``numbered(number, text)`` may wrap it with its place, counted from 1.
    Items are gathered in blocks of positions, blocks are rendered, and only the few block
    texts of a document meet, so no state holds an order's items one by one.
    """
    block = F.floor(F.col("pos") / per_block)
    gathered = items.select("document_id", block.alias("_block"), "pos", text.alias("_text")).groupBy("document_id", "_block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "_text")))["_text"].alias("_texts"))
    if numbered is not None:
        earlier = W.partitionBy("document_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        gathered = gathered.withColumn("_before", F.coalesce(F.sum(F.size("_texts")).over(earlier), F.lit(0)))
        shown = F.transform("_texts", lambda x, i: numbered(F.col("_before") + i + 1, x))
    else:
        shown = F.col("_texts")
    blocks = gathered.select("document_id", "_block", F.size("_texts").alias("_n"), F.array_join(shown, separator).alias("_joined"))
    whole = F.sort_array(F.collect_list(F.struct("_block", "_joined")))["_joined"]
    return blocks.groupBy("document_id").agg(F.array_join(whole, separator).alias("items_text"), F.sum("_n").alias("items_count"))


# --- result (A2, A3, A10) -----------------------------------------------------------------------

def overall_confidence(fields: DataFrame) -> DataFrame:
    """Weakest confidence over fields with a value, three decimals; 0 without one (A2)."""
    weakest = F.min(F.when(F.col("value").isNotNull(), F.col("confidence")))
    return fields.groupBy("document_id").agg(F.round(F.coalesce(weakest, F.lit(0.0)), 3).alias("overall_confidence"))


def flagged_rows(fields: DataFrame, flags: DataFrame) -> DataFrame:
    """(document, field) pairs needing review: flagged by a pass or named by an error rule."""
    named = flags.filter(F.col("severity") == "error").select(
        "document_id", F.explode("affected_fields").alias("field_path"))
    return fields.filter("flagged").select("document_id", "field_path").union(named).distinct()


def flagged_fields(fields: DataFrame, flags: DataFrame) -> DataFrame:
    """Sorted distinct list per document (A3); bounded by the catalog."""
    return flagged_rows(fields, flags).groupBy("document_id").agg(
        F.array_sort(F.collect_set("field_path")).alias("fields_flagged"))


def field_map(fields: DataFrame) -> DataFrame:
    """Field rows as one map per document (D9); one entry per catalog path."""
    entry = F.struct("field_path", F.struct("value", "confidence", F.col("source_model").alias("source")))
    return fields.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"))


def assemble_results(fields: DataFrame, flags: DataFrame, items: DataFrame | None = None, routing: DataFrame | None = None) -> DataFrame:
    """One result row per document: record, weakest confidence, review list, field map, flags, severity counts.

    Fields are grouped once for the record, the score, the flagged set and the field map, flags once for
    their list, counts and named fields. Rows named ``line_items.N`` count in the score and
    in no list. ``items`` adds the items as one JSON array text; ``routing`` may add per-document
    columns (primary model, timing, ...). All joins are on ``document_id``. Every document with field rows has a result, with
    confidence 0 where no field has a value.
    """
    item_row = F.col("field_path").startswith("line_items.")
    entry = F.struct("field_path", F.struct("value", "confidence", F.col("source_model").alias("source")))
    weakest = F.min(F.when(F.col("value").isNotNull(), F.col("confidence")))
    grouped = fields.groupBy("document_id").agg(
        *record_values(),
        F.round(F.coalesce(weakest, F.lit(0.0)), 3).alias("overall_confidence"),
        F.collect_set(F.when(F.col("flagged") & ~item_row, F.col("field_path"))).alias("_flagged"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~item_row, entry)))).alias("fields"))
    po = record_of(grouped, "overall_confidence", "_flagged", "fields")
    error = F.col("severity") == "error"
    raised = flags.groupBy("document_id").agg(
        F.count_if(error).alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.array_distinct(F.flatten(F.collect_set(F.when(error, F.col("affected_fields"))))).alias("_named"),
        F.transform(F.array_sort(F.collect_list(F.struct("rule_order", "rule", "severity", "message"))),
                    lambda f: F.struct(f["rule"].alias("rule"), f["severity"].alias("severity"), f["message"].alias("message"))).alias("flags"))
    none = F.array().cast("array<string>")
    out = po.join(raised, "document_id", "left").withColumns({
        "fields_flagged": F.array_sort(F.array_union("_flagged", F.coalesce("_named", none))),
        "errors": F.coalesce("errors", F.lit(0)), "warnings": F.coalesce("warnings", F.lit(0)),
        "flags": F.coalesce("flags", F.array().cast("array<struct<rule:string,severity:string,message:string>>")),
    }).drop("_flagged", "_named")
    if items is not None:
        texts = item_texts(items, F.to_json(F.struct(*item_columns(items))), separator=",").select("document_id", "items_text")
        out = out.join(texts, "document_id", "left").withColumn(
            "line_items", F.concat(F.lit("["), F.coalesce("items_text", F.lit("")), F.lit("]"))).drop("items_text")
    return out.join(routing, "document_id", "left") if routing is not None else out


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
