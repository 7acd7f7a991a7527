"""Validation rules over purchase orders derived from ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import numbers as N
from ledgerlens.operators import rules as R
from ledgerlens.plans.registry import query
from ledgerlens.sources.views import AS_OF, duck, view

PO, ITEMS = duck("fx_po"), duck("fx_items")
TOL = "greatest(0.05::double, 0.01::double * greatest(abs({a}), abs({b}), 1.0::double))"
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"


def off(a: str, b: str) -> str:
    return f"(abs({a} - {b}) > {TOL.format(a=a, b=b)})"


def day(c: str) -> str:
    """ISO, compact, then year/month/day with slashes."""
    return (
        f"coalesce(case when regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_cast({c} as date) end, "
        f"case when regexp_full_match({c}, '\\d{{8}}') then try_cast(try_strptime({c}, '%Y%m%d') as date) end, "
        f"case when regexp_full_match({c}, '\\d{{1,4}}/\\d{{1,2}}/\\d{{1,2}}') then "
        f"try_cast(lpad(split_part({c}, '/', 1), 4, '0') || '-' || lpad(split_part({c}, '/', 2), 2, '0') || '-' || "
        f"lpad(split_part({c}, '/', 3), 2, '0') as date) end)"
    )


SUMMARY = f"""(select document_id, count(*) n_items, count(line_total) n_line_totals,
  cast(sum(cast(line_total as decimal(28,6))) as double) items_sum,
  list_sort(list(distinct upper(currency))) codes from {ITEMS} group by document_id)"""
HEADER = f"""(select po.*, coalesce(n_items, 0) n_items, coalesce(n_line_totals, 0) n_line_totals, items_sum,
  coalesce(codes, []) codes, {day('po_date')} pd, {day('due_date')} dd,
  subtotal + 0.0::double + coalesce(shipping, 0.0::double) - 0.0::double computed
  from {PO} po left join {SUMMARY} s using (document_id))"""
AS_OF_SQL = f"date '{AS_OF}'"

_FLAG_SQL = {
    "required_fields": [
        ("po_number is null or trim(po_number) = ''", "'required_field_missing:po_number'", "'error'", "po_number"),
        ("vendor_name is null or trim(vendor_name) = ''", "'required_field_missing:vendor.name'", "'error'", "vendor.name"),
    ],
    "expected_fields": [
        ("po_date is null or trim(po_date) = ''", "'expected_field_missing:po_date'", "'warning'", "po_date"),
        ("grand_total is null", "'expected_field_missing:totals.grand_total'", "'warning'", "totals.grand_total"),
    ],
    "line_sum": [
        (f"n_line_totals > 0 and subtotal is not null and {off('items_sum', 'subtotal')}",
         "'totals.line_items_sum_mismatch'", "'error'", "totals.subtotal,line_items"),
    ],
    "grand_total": [
        (f"grand_total is not null and subtotal is not null and {off('computed', 'grand_total')}",
         "'totals.grand_total_mismatch'",
         "case when regexp_matches(lower(payment_terms), 'paid|balance due|balance|partial|deposit') or "
         "(abs(computed - grand_total) > 0.05 and abs(computed - grand_total) = round(abs(computed - grand_total), 2)) "
         "then 'warning' else 'error' end",
         "totals.grand_total,totals.subtotal,totals.tax_amount,totals.shipping,totals.discount"),
    ],
    "no_items": [("n_items = 0", "'line_items.empty'", "'warning'", "line_items")],
    "dates": [
        ("po_date <> '' and pd is null", "'date.po_date_invalid_format'", "'warning'", "po_date"),
        ("due_date <> '' and dd is null", "'date.due_date_invalid_format'", "'warning'", "due_date"),
        ("dd < pd", "'date.due_before_po'", "'error'", "po_date,due_date"),
        (f"date_diff('day', {AS_OF_SQL}, pd) > 365", "'date.po_date_far_future'", "'warning'", "po_date"),
        (f"date_diff('day', pd, {AS_OF_SQL}) > 3650", "'date.po_date_far_past'", "'warning'", "po_date"),
    ],
    "currency": [
        ("len(list_distinct(list_append(codes, upper(currency)))) > 1", "'currency.inconsistent'", "'warning'",
         "currency,totals.currency"),
    ],
    "formats": [
        (f"vendor_email <> '' and not regexp_matches(trim(vendor_email), '{EMAIL}')",
         "'format.invalid_email:vendor.email'", "'warning'", "vendor.email"),
        ("po_number <> '' and regexp_replace(po_number, '[^a-zA-Z0-9]', '', 'g') = ''",
         "'format.po_number_no_alphanumeric'", "'error'", "po_number"),
    ],
}


def flags_sql(*names: str) -> str:
    return " union all ".join(
        f"select document_id, {rule} as \"rule\", {sev} as severity, '{fields}' as affected_fields "
        f"from {HEADER} h where {cond}"
        for n in names for cond, rule, sev, fields in _FLAG_SQL[n]
    )


ITEM_FLAGS_SQL = f"""select document_id, 'line_item.total_mismatch:' || cast(pos as varchar) as "rule",
  'warning' as severity, 'line_items' as affected_fields from {ITEMS} i
  where {off('quantity * unit_price', 'line_total')}"""
ALL_FLAGS_SQL = flags_sql(*_FLAG_SQL) + " union all " + ITEM_FLAGS_SQL


def _placed() -> str:
    """Every flag with its place in the order of display: the groups in turn, item flags behind the totals."""
    rows = [f"select document_id, {10 * g + i} as place, {rule} as \"rule\" from {HEADER} h where {cond}"
            for g, n in enumerate(_FLAG_SQL) for i, (cond, rule, _, _) in enumerate(_FLAG_SQL[n])]
    items = 10 * list(_FLAG_SQL).index("grand_total") + 9
    return " union all ".join([*rows, f'select document_id, {items}, "rule" from ({ITEM_FLAGS_SQL}) i'])


def shown(flags):
    return flags.select("document_id", "rule", "severity", F.array_join("affected_fields", ",").alias("affected_fields"))


def _one(spark, d, rule):
    needs = rule in R.NEEDS_ITEMS
    return shown(R.header_flags(view(spark, d, "fx_po"), view(spark, d, "fx_items") if needs else None, AS_OF, [rule]))


@query(flags_sql("line_sum"))
def rule_line_sum(spark, d):
    return _one(spark, d, "line_sum")


@query(flags_sql("grand_total"))
def rule_grand_total(spark, d):
    return _one(spark, d, "grand_total")


@query(ITEM_FLAGS_SQL)
def rule_line_items(spark, d):
    return shown(R.item_flags(view(spark, d, "fx_items")))


@query(flags_sql("no_items"))
def rule_empty(spark, d):
    return _one(spark, d, "no_items")


@query(flags_sql("dates"))
def rule_dates(spark, d):
    return _one(spark, d, "dates")


@query(flags_sql("dates").replace(AS_OF_SQL, "date '1993-06-30'"))
def rule_dates_ahead(spark, d):
    """The date rules seen from an early day, when many orders lie far ahead."""
    return shown(R.header_flags(view(spark, d, "fx_po"), None, "1993-06-30", ["dates"]))


@query(flags_sql("currency"))
def rule_currency(spark, d):
    return _one(spark, d, "currency")


@query(flags_sql("formats"))
def rule_formats(spark, d):
    return _one(spark, d, "formats")


@query(flags_sql("required_fields", "expected_fields"))
def rule_presence(spark, d):
    po = view(spark, d, "fx_po")
    return shown(R.header_flags(po, None, AS_OF, ["required_fields", "expected_fields"]))


@query(ALL_FLAGS_SQL)
def validation_flags(spark, d):
    return shown(R.validate(view(spark, d, "fx_po"), view(spark, d, "fx_items"), AS_OF))


@query(f"""select document_id, string_agg("rule", ',' order by place, "rule") as rules, count(*) as n_worded from ({_placed()}) f group by document_id""")
def flags_in_order(spark, d):
    """A document's flags as a reviewer reads them: in the order of the rules, each with a message."""
    raised = R.validate(view(spark, d, "fx_po"), view(spark, d, "fx_items"), AS_OF)
    listed = raised.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("rule_order", "rule"))).alias("flags"), F.count_if(F.length("message") > 0).alias("n_worded"))
    return listed.select("document_id", F.array_join(F.transform("flags", lambda f: f["rule"]), ",").alias("rules"), "n_worded")


@query(f"""select document_id, count(*) filter (severity = 'error') errors,
  count(*) filter (severity = 'warning') warnings from ({ALL_FLAGS_SQL}) f group by document_id""")
def severity_counts(spark, d):
    return R.severity_counts(R.validate(view(spark, d, "fx_po"), view(spark, d, "fx_items"), AS_OF))


@query(f"""select document_id, -1 as pos, 'currency is not three characters' as reason from {PO} p where length(currency) <> 3
  union all select document_id, -1, 'totals.' || n || ' is negative' from (
    select document_id, unnest(['subtotal', 'shipping', 'grand_total']) n, unnest([subtotal, shipping, grand_total]) v
    from {PO} p) u where v < 0
  union all select document_id, pos, reason from (
    select document_id, pos, unnest([
      case when quantity < 0 then 'quantity is negative' end, case when unit_price < 0 then 'unit_price is negative' end,
      case when line_total < 0 then 'line_total is negative' end, case when tax_rate < 0 then 'tax_rate is negative' end,
      case when tax_rate > 1 then 'tax_rate is above one' end,
      case when length(currency) <> 3 then 'currency is not three characters' end]) reason
    from (select document_id, pos, quantity, unit_price, line_total - 20000 as line_total, tax_rate * 20 as tax_rate,
                 case when currency = 'EUR' then 'EURO' else currency end as currency from {ITEMS} i) x) y
    where reason is not null""")
def record_constraints(spark, d):
    """Items are shifted so that some of every kind break a constraint."""
    items = (
        view(spark, d, "fx_items")
        .withColumn("line_total", F.col("line_total") - 20000)
        .withColumn("tax_rate", F.col("tax_rate") * 20)
        .withColumn("currency", F.when(F.col("currency") == "EUR", "EURO").otherwise(F.col("currency")))
    )
    head = R.header_violations(view(spark, d, "fx_po")).select("document_id", F.lit(-1).alias("pos"), "reason")
    return head.unionByName(R.item_violations(items))


@query(f"""select document_id, pos, abs(quantity * unit_price - line_total)
  <= {TOL.format(a='quantity * unit_price', b='line_total')} as ok from {ITEMS} i""")
def within_tolerance(spark, d):
    i = view(spark, d, "fx_items")
    return i.select("document_id", "pos", N.within_tolerance(F.col("quantity") * F.col("unit_price"), F.col("line_total")).alias("ok"))


_RAW_MONEY = """case pos % 6 when 0 then '$' || cast(line_total as string) when 1 then 'USD ' || cast(line_total as string)
  when 2 then cast(line_total as string) || ' EUR' when 3 then '1,2' || cast(line_total as string)
  when 4 then cast(quantity as string) || 'k' else '  ' || cast(unit_price as string) || 'd' end"""
NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_CLEAN = "trim(replace(regexp_replace(regexp_replace(raw, '[£$€¥₹]', '', 'g'), '\\b[A-Z]{3}\\b', '', 'g'), ',', ''))"


@query(f"""select document_id, pos, case when regexp_full_match({_CLEAN}, '{NUM}') then try_cast({_CLEAN} as double) end as amount
  from (select document_id, pos, {_RAW_MONEY} as raw from {ITEMS} i) r""")
def coerce_numeric(spark, d):
    raw = view(spark, d, "fx_items").select("document_id", "pos", F.expr(_RAW_MONEY).alias("raw"))
    return raw.select("document_id", "pos", N.to_number(F.col("raw")).alias("amount"))


_RAW_DATE = """case document_id % 5 when 0 then replace(po_date, '-', '/') when 1 then replace(po_date, '-', '')
  when 2 then po_date when 3 then substring(po_date, 1, 7) else '15/01/' || substring(po_date, 1, 4) end"""


@query(f"""select document_id, cast({day('raw')} as varchar) as parsed
  from (select document_id, {_RAW_DATE} as raw from {PO} p) r""")
def parse_date(spark, d):
    raw = view(spark, d, "fx_po").select("document_id", F.expr(_RAW_DATE).alias("raw"))
    return raw.select("document_id", N.parse_date(F.col("raw")).cast("string").alias("parsed"))


_RAW_CONF = """case pos % 5 when 0 then cast(tax_rate as string) when 1 then cast(quantity as string)
  when 2 then 'high' when 3 then null else '-' || cast(quantity as string) end"""


@query(f"""select document_id, pos, case when raw is null or not regexp_full_match(raw, '{NUM}') then 0.5::double
  else greatest(0::double, least(1::double, case when try_cast(raw as double) > 1 then try_cast(raw as double) / 100::double
  else try_cast(raw as double) end)) end as confidence from (select document_id, pos, {_RAW_CONF} as raw from {ITEMS} i) r""")
def coerce_confidence(spark, d):
    raw = view(spark, d, "fx_items").select("document_id", "pos", F.expr(_RAW_CONF).alias("raw"))
    return raw.select("document_id", "pos", N.coerce_confidence(F.col("raw")).alias("confidence"))
