"""Business rules over a purchase-order header and its items.

A rule is a list of :class:`Flag` entries over the columns of one header row joined
to its item summary. All header rules run in a single pass: the flags become an
array per row and ``inline`` turns them into the flag table, so adding a rule adds
neither a scan nor a shuffle. The only shuffle is the item summary, which combines
map-side; per-item flags need none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.constants import EXPECTED_FIELDS, MODEL_SOURCES, PAYMENT_WORDS, REQUIRED_FIELDS, REVIEW_REASONS
from ledgerlens.functions import numbers as N, text as T
from ledgerlens.operators.frames import with_columns_present

HEADER_TYPES = {
    "po_number": "string", "po_date": "string", "due_date": "string", "payment_terms": "string",
    "currency": "string", "vendor_name": "string", "vendor_email": "string", "buyer_email": "string",
    "subtotal": "double", "tax_amount": "double", "shipping": "double", "discount": "double",
    "grand_total": "double", "totals_currency": "string", "flagged_fields": "array<string>",
}
ITEM_TYPES = {
    "description": "string", "quantity": "double", "unit_price": "double",
    "line_total": "double", "currency": "string",
}
FLAG_TYPE = "struct<rule_order:int,rule:string,message:string,severity:string,affected_fields:array<string>>"


@dataclass(frozen=True)
class Flag:
    """One possible flag of a rule: when ``hit`` holds, the rest is emitted."""

    hit: Column
    rule: str | Column
    severity: str | Column
    message: Column
    fields: Sequence[str]

    def entry(self, order: int) -> Column:
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        body = F.struct(
            F.lit(order).cast("int").alias("rule_order"), as_col(self.rule).alias("rule"),
            self.message.alias("message"), as_col(self.severity).alias("severity"),
            F.array(*[F.lit(f) for f in self.fields]).alias("affected_fields"),
        )
        return F.when(self.hit, body.cast(FLAG_TYPE))


def money(c: Column) -> Column:
    return F.format_string("%.2f", F.round(c, 2))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def blank(c: Column) -> Column:
    return c.isNull() | (T.strip(c.cast("string")) == "")


def present(c: Column) -> Column:
    """Non-null and non-empty, without trimming."""
    return F.coalesce(c != "", F.lit(False))


# --- item summary -------------------------------------------------------------

def item_summary(items: DataFrame) -> DataFrame:
    """Counts, sum and currencies per document (A4, A5), in one shuffle.

    The currency set holds distinct codes, not items, so the state of a document
    does not follow its number of items; everything combines map-side.
    """
    items = with_columns_present(items, ITEM_TYPES)
    return items.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count("line_total").alias("n_line_totals"),
        N.exact_sum(F.col("line_total")).alias("items_sum"),
        F.array_sort(F.collect_set(F.upper(F.nullif(F.col("currency"), F.lit(""))))).alias("item_currencies"),
    )


# --- header rules ---------------------------------------------------------------

def required_fields(as_of: Column) -> list[Flag]:
    columns = {"po_number": F.col("po_number"), "vendor.name": F.col("vendor_name")}
    flags = []
    for path, label in REQUIRED_FIELDS.items():
        doubtful = F.coalesce(F.array_contains("flagged_fields", path), F.lit(False))
        message = F.when(doubtful, F.lit(f"{label} is held for review; confirm it first.")).otherwise(
            F.lit(f"{label} is absent and is required downstream.")
        )
        flags.append(Flag(blank(columns[path]), f"required_field_missing:{path}", "error", message, [path]))
    return flags


def expected_fields(as_of: Column) -> list[Flag]:
    columns = {"po_date": F.col("po_date"), "totals.grand_total": F.col("grand_total")}
    return [
        Flag(blank(columns[path]), f"expected_field_missing:{path}", "warning",
             F.lit(f"{label} is absent; check the document."), [path])
        for path, label in EXPECTED_FIELDS.items()
    ]


def line_sum(as_of: Column) -> list[Flag]:
    total, stated = F.col("items_sum"), F.col("subtotal")
    comparable = (F.col("n_line_totals") > 0) & stated.isNotNull()
    return [Flag(
        comparable & ~N.within_tolerance(total, stated), "totals.line_items_sum_mismatch", "error",
        _say("Items add up to ", money(total), ", subtotal says ", money(stated),
             " (off by ", money(F.abs(total - stated)), ")."),
        ["totals.subtotal", "line_items"],
    )]


def grand_total(as_of: Column, round_amount: bool = False) -> list[Flag]:
    """``round_amount`` switches the part-payment test from the double-equality
    form (the compatible one) to whole currency units."""
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    subtotal, stated = F.col("subtotal"), F.col("grand_total")
    computed = subtotal + zero("tax_amount") + zero("shipping") - zero("discount")
    diff = F.abs(computed - stated)
    terms = F.lower(F.coalesce(F.col("payment_terms"), F.lit("")))
    worded = terms.rlike("|".join(PAYMENT_WORDS))
    clean_step = (diff % 1.0 == 0.0) if round_amount else (diff == F.round(diff, 2))
    part_payment = worded | ((diff > 0.05) & clean_step)
    return [Flag(
        stated.isNotNull() & subtotal.isNotNull() & ~N.within_tolerance(computed, stated),
        "totals.grand_total_mismatch",
        F.when(part_payment, F.lit("warning")).otherwise(F.lit("error")),
        _say(F.when(part_payment, F.lit("Probably a balance after a part payment: ")).otherwise(F.lit("")),
             "components give ", money(computed), ", grand total says ", money(stated),
             " (off by ", money(diff), ")."),
        ["totals.grand_total", "totals.subtotal", "totals.tax_amount", "totals.shipping", "totals.discount"],
    )]


def no_items(as_of: Column) -> list[Flag]:
    return [Flag(F.coalesce(F.col("n_items"), F.lit(0)) == 0, "line_items.empty", "warning",
                 F.lit("The order has no items; check the document."), ["line_items"])]


def dates(as_of: Column) -> list[Flag]:
    po, due = N.parse_date(F.col("po_date")), N.parse_date(F.col("due_date"))
    unreadable = lambda name, parsed: Flag(
        present(F.col(name)) & parsed.isNull(), f"date.{name}_invalid_format", "warning",
        _say(f"{name} '", F.col(name), "' is not a date (YYYY-MM-DD)."), [name])
    return [
        unreadable("po_date", po),
        unreadable("due_date", due),
        Flag(due < po, "date.due_before_po", "error",
             _say("Due ", F.col("due_date"), " is before the order date ", F.col("po_date"), "."),
             ["po_date", "due_date"]),
        Flag(F.datediff(po, as_of) > 365, "date.po_date_far_future", "warning",
             _say("Order date ", F.col("po_date"), " is over a year ahead."), ["po_date"]),
        Flag(F.datediff(as_of, po) > 3650, "date.po_date_far_past", "warning",
             _say("Order date ", F.col("po_date"), " is over ten years back."), ["po_date"]),
    ]


def currency(as_of: Column) -> list[Flag]:
    code = lambda name: F.upper(F.nullif(F.col(name), F.lit("")))
    item_codes = F.coalesce(F.col("item_currencies"), F.array().cast("array<string>"))
    head = F.array_compact(F.array(code("currency"), code("totals_currency")))
    shown = F.array_join(F.concat(
        F.array_compact(F.array(F.concat(F.lit("document="), code("currency")),
                                F.concat(F.lit("totals="), code("totals_currency")))),
        F.transform(item_codes, lambda c: F.concat(F.lit("items="), c)),
    ), ", ")
    return [Flag(F.size(F.array_distinct(F.concat(head, item_codes))) > 1, "currency.inconsistent", "warning",
                 _say("Several currencies: ", shown, "."), ["currency", "totals.currency"])]


def formats(as_of: Column) -> list[Flag]:
    flags = [
        Flag(present(F.col(name)) & ~T.is_email(F.col(name)), f"format.invalid_email:{path}", "warning",
             _say("'", F.col(name), "' is not an email address."), [path])
        for path, name in (("vendor.email", "vendor_email"), ("buyer.email", "buyer_email"))
    ]
    only_symbols = F.regexp_replace("po_number", "[^a-zA-Z0-9]", "") == ""
    flags.append(Flag(present(F.col("po_number")) & only_symbols, "format.po_number_no_alphanumeric", "error",
                      _say("PO number '", F.col("po_number"), "' has no letter or digit."), ["po_number"]))
    return flags


#: header rules in reviewer order (L4); extend with your own ``f(as_of) -> list[Flag]``
HEADER_RULES: dict[str, Callable[[Column], list[Flag]]] = {
    "required_fields": required_fields,
    "expected_fields": expected_fields,
    "line_sum": line_sum,
    "grand_total": grand_total,
    "no_items": no_items,
    "dates": dates,
    "currency": currency,
    "formats": formats,
}
#: place of each rule in the flag order; the per-item rule sits between totals and "no items"
RULE_ORDER = {name: 10 * i for i, name in enumerate(
    ("required_fields", "expected_fields", "line_sum", "grand_total", "line_items",
     "no_items", "dates", "currency", "formats"), 1)}
NEEDS_ITEMS = {"line_sum", "no_items", "currency"}


def header_flags(
    po: DataFrame, items: DataFrame | None, as_of, rules: dict[str, Callable] | Sequence[str] | None = None,
) -> DataFrame:
    """Flags of the chosen header rules: one row per flag."""
    chosen = rules if isinstance(rules, dict) else {n: HEADER_RULES[n] for n in (rules or HEADER_RULES)}
    joined = with_columns_present(po, HEADER_TYPES)
    if items is not None and (NEEDS_ITEMS & set(chosen) or not set(chosen) <= set(HEADER_RULES)):
        joined = joined.join(item_summary(items), "document_id", "left")
    day = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of
    entries = [
        flag.entry(RULE_ORDER.get(name, 1000) + i)
        for name, rule in chosen.items() for i, flag in enumerate(rule(day))
    ]
    # as a column of its own the array is made by compiled code; in a generator or below a lambda it is not. The outer form
    # keeps Spark from filtering on the array first, which would make it twice; rules that do not hit are null rows
    listed = joined.select("document_id", F.array(*entries).alias("_flags"))
    return listed.select("document_id", F.inline_outer("_flags")).filter(F.col("rule_order").isNotNull())


def item_flags(items: DataFrame) -> DataFrame:
    """quantity x unit price against the line total (V5): a filter, no shuffle."""
    q, p, t = F.col("quantity"), F.col("unit_price"), F.col("line_total")
    label = F.coalesce(F.nullif(F.substring("description", 1, 40), F.lit("")),
                       F.concat(F.lit("line item "), (F.col("pos") + 1).cast("string")))
    return (
        with_columns_present(items, ITEM_TYPES)
        .filter(q.isNotNull() & p.isNotNull() & t.isNotNull() & ~N.within_tolerance(q * p, t))
        .select(
            "document_id", F.lit(RULE_ORDER["line_items"]).cast("int").alias("rule_order"),
            F.concat(F.lit("line_item.total_mismatch:"), F.col("pos").cast("string")).alias("rule"),
            _say("'", label, "': quantity times price gives ", money(q * p), ", line says ", money(t),
                 " (off by ", money(F.abs(q * p - t)), ").").alias("message"),
            F.lit("warning").alias("severity"),
            F.array(F.lit("line_items")).alias("affected_fields"),
        )
    )


def validate(po: DataFrame, items: DataFrame, as_of, rules: dict[str, Callable] | None = None) -> DataFrame:
    """The whole flag table (U3). Order for display: ``document_id, rule_order, rule``."""
    return header_flags(po, items, as_of, rules).unionByName(item_flags(items))


def severity_counts(flags: DataFrame) -> DataFrame:
    """Errors and warnings per document."""
    return flags.groupBy("document_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


# --- record constraints (V14) ----------------------------------------------------

def header_violations(po: DataFrame) -> DataFrame:
    """Rows that break a record constraint, with the reason (a reject table)."""
    po = with_columns_present(po, HEADER_TYPES)
    money_columns = ("subtotal", "tax_amount", "shipping", "discount", "grand_total")
    reasons = [F.when(F.col(c) < 0, F.lit(f"totals.{c} is negative")) for c in money_columns]
    reasons += [F.when(F.length(c) != 3, F.lit(f"{p} is not three characters"))
                for c, p in (("currency", "currency"), ("totals_currency", "totals.currency"))]
    return po.select("document_id", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def item_violations(items: DataFrame) -> DataFrame:
    items = with_columns_present(items, {**ITEM_TYPES, "tax_rate": "double"})
    reasons = [F.when(F.col(c) < 0, F.lit(f"{c} is negative"))
               for c in ("quantity", "unit_price", "line_total", "tax_rate")]
    reasons += [F.when(F.col("tax_rate") > 1, F.lit("tax_rate is above one")),
                F.when(F.length("currency") != 3, F.lit("currency is not three characters")),
                F.when(blank(F.col("description")), F.lit("description is missing"))]
    return items.select("document_id", "pos", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def field_violations(fields: DataFrame) -> DataFrame:
    """Confidence outside [0, 1], a flag without a reason, an unknown source or reason."""
    fields = with_columns_present(fields, {"source_model": "string"})
    reasons = [
        F.when(~F.col("source_model").isin(*MODEL_SOURCES), F.lit("unknown source")),
        F.when(~F.col("review_reason").isin(*REVIEW_REASONS), F.lit("unknown review reason")),
        F.when(~F.col("confidence").between(0.0, 1.0) | F.col("confidence").isNull(), F.lit("confidence outside [0, 1]")),
        F.when(F.col("flagged") & F.col("review_reason").isNull(), F.lit("flag without a reason")),
    ]
    return fields.select("document_id", "field_path", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))
