"""Records, review, exports, jobs, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.constants import ALLOWED_MIME_TYPES, ALWAYS_ESCALATE
from ledgerlens.operators import assemble as A, flow as W, jobs as J, review as V, rules as R
from ledgerlens.operators.frames import stored, written, written_in_place
from ledgerlens.plans.registry import query
from ledgerlens.plans.reply_queries import DISAGREES, FALLBACK, MERGED, both_passes, fields_sql, merged
from ledgerlens.plans.rule_queries import ALL_FLAGS_SQL, ITEMS, PO
from ledgerlens.session import work_dir
from ledgerlens.sinks import exports as E
from ledgerlens.sources import files as S
from ledgerlens.sources.views import AS_OF, duck, prepared_by_document, sql_text, table, view
from ledgerlens.streaming import maintained as MT, streams as ST

CORR, APPR, JOBS, FILES, MAIL = (duck(n) for n in ("fx_corrections", "fx_approvals", "fx_jobs", "fx_files", "fx_mail"))


def flags(spark, d, known=None):
    known = known or inputs(spark, d)
    return R.validate(view(spark, d, "fx_po", known), view(spark, d, "fx_items", known), AS_OF)


def inputs(spark, d):
    """Headers and items, which the steps of one query read several times."""
    return prepared_by_document(spark, d)


# --- items and records ---------------------------------------------------------------------------

_NUMERIC = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def _item_text(name: str) -> str:
    return (f"case when json_type(e, '$.{name}.value') is not null then e ->> '$.{name}.value' else e ->> '$.{name}' end")


def _item_number(name: str) -> str:
    clean = f"trim(replace(regexp_replace(regexp_replace({_item_text(name)}, '[£$€¥₹]', '', 'g'), '\\b[A-Z]{{3}}\\b', '', 'g'), ',', ''))"
    return f"case when regexp_full_match({clean}, '{_NUMERIC}') then try_cast({clean} as double) end"


_PARSED = f"""(select document_id, line_no, partkey, suppkey, price, pos, {_item_text('description')} as description,
   {_item_text('part_number')} as part_number, {_item_text('currency')} as currency, {_item_number('quantity')} as quantity,
   {_item_number('unit_price')} as unit_price, {_item_number('line_total')} as line_total, {_item_number('tax_rate')} as tax_rate,
   try_cast({_item_text('line_number')} as int) as line_number, kind, json_type(e) as element
  from (select *, unnest(case kind when 'ARRAY' then cast(cast(raw as json) as json[]) when 'OBJECT' then [cast(raw as json)] else [null] end) as e,
     unnest(case kind when 'ARRAY' then range(0, cast(json_array_length(raw) as bigint)) when 'OBJECT' then [0] else [-1] end) as pos
     from (select *, json_type(raw) as kind from {duck('fx_item_replies')} r) k) x)"""


LINE_ITEMS_SQL = f"""select document_id, line_no, partkey, suppkey, price, cast(pos as int) as pos, description, part_number, quantity, unit_price,
  currency, line_total, tax_rate, line_number,
  case when kind not in ('ARRAY', 'OBJECT') then 'not a list' when element <> 'OBJECT' then 'not an object'
    when coalesce(description, '') = '' then 'missing description' when quantity < 0 then 'quantity is negative'
    when unit_price < 0 then 'unit_price is negative' when line_total < 0 then 'line_total is negative'
    when tax_rate < 0 then 'tax_rate is negative' when tax_rate > 1 then 'tax_rate is above one'
    when length(currency) <> 3 then 'currency is not three characters' end as reject_reason
  from {_PARSED} p"""


@query(LINE_ITEMS_SQL)
def line_items_parse(spark, d):
    return A.parse_line_items(view(spark, d, "fx_item_replies")).drop("unit", "notes", "unread_numbers")


def _pick(path: str) -> str:
    return f"nullif(trim(max(case when field_path = '{path}' then value end)), '')"


def wide_sql(fields: str) -> str:
    """The header of every document from its field rows."""
    return f"""(select document_id, {_pick('po_number')} po_number, {_pick('po_date')} po_date, {_pick('due_date')} due_date,
  {_pick('payment_terms')} payment_terms, case when length({_pick('currency')}) = 3 then {_pick('currency')} end currency,
  {_pick('vendor.name')} vendor_name, {_pick('vendor.email')} vendor_email, {_pick('buyer.name')} buyer_name,
  {", ".join(f"case when regexp_full_match({_pick('totals.' + k)}, '{_NUMERIC}') then try_cast({_pick('totals.' + k)} as double) end {k}" for k in ('subtotal', 'shipping', 'grand_total'))}
  from {fields} m group by document_id)"""


WIDE = wide_sql(MERGED)


@query(f"""select *, vendor_name is null and vendor_email is null as no_vendor, buyer_name is null as no_buyer from {WIDE} w""")
def build_po(spark, d):
    flat = A.flat_header(A.build_po(merged(spark, d)), F.col("vendor").isNull().alias("no_vendor"), F.col("buyer").isNull().alias("no_buyer"))
    return flat.select("document_id", "po_number", "po_date", "due_date", "payment_terms", "currency", "vendor_name",
                       "vendor_email", "buyer_name", "subtotal", "shipping", "grand_total", "no_vendor", "no_buyer")


@query(f"""select document_id, round(coalesce(min(case when value is not null then confidence end), 0::double), 3) as overall_confidence
  from {MERGED} m group by document_id""")
def overall_confidence(spark, d):
    return A.overall_confidence(merged(spark, d))


FLAGGED = f"""(select document_id, field_path from {MERGED} m where flagged union
  select document_id, unnest(string_split(affected_fields, ',')) from ({ALL_FLAGS_SQL}) f where severity = 'error')"""


@query(f"select document_id, array_to_string(list_sort(list(field_path)), ',') as fields_flagged from {FLAGGED} f group by document_id")
def flagged_fields(spark, d):
    known = inputs(spark, d)
    out = A.flagged_fields(merged(spark, d, known), flags(spark, d, known))
    return out.withColumn("fields_flagged", F.array_join("fields_flagged", ","))


def num(c: str) -> str:
    """Shortest decimal text of a double (all amounts here are under 1e7)."""
    return f"cast({c} as varchar)"


def js(c: str) -> str:
    return f"cast(to_json({c}) as varchar)"


def _pairs(*pairs: tuple[str, str]) -> str:
    inner = ", ".join(f"case when {c} is not null then '\"{k}\":' || {text} end" for k, c, text in pairs)
    return f"'{{' || concat_ws(',', {inner}) || '}}'"


_ITEM_JSON = _pairs(
    ("description", "description", js("description")), ("part_number", "part_number", js("part_number")),
    ("quantity", "quantity", "cast(quantity as varchar)"), ("unit_price", "unit_price", "cast(unit_price as varchar)"),
    ("currency", "currency", js("currency")), ("line_total", "line_total", "cast(line_total as varchar)"),
    ("tax_rate", "tax_rate", "cast(tax_rate as varchar)"))


@query(f"""select document_id, po_number, vendor_name, coalesce(c.overall_confidence, 0) as overall_confidence,
  coalesce(l.fields_flagged, '') as fields_flagged, coalesce(s.errors, 0) as errors, coalesce(s.warnings, 0) as warnings,
  n_fields, vendor_source, coalesce(rules, '') as rules, '[' || coalesce(items, '') || ']' as line_items
  from {WIDE} w join (select document_id, count(*) n_fields, max(case when field_path = 'vendor.name' then source_model end) vendor_source
    from {MERGED} m group by document_id) n using (document_id)
  left join (select document_id, string_agg({_ITEM_JSON}, ',' order by pos) items from {ITEMS} i group by document_id) i using (document_id)
  left join (select document_id, round(min(case when value is not null then confidence end), 3) overall_confidence from {MERGED} m group by document_id) c using (document_id)
  left join (select document_id, array_to_string(list_sort(list(field_path)), ',') fields_flagged from {FLAGGED} f group by document_id) l using (document_id)
  left join (select document_id, count(*) filter (severity = 'error') errors, count(*) filter (severity = 'warning') warnings,
             string_agg("rule", ',' order by "rule") rules
             from ({ALL_FLAGS_SQL}) f group by document_id) s using (document_id)""")
def results(spark, d):
    """The assembled result row per document."""
    known = inputs(spark, d)
    # a union forgets that its rows lie by document, a table of them does not
    raised = written(flags(spark, d, known), "flags")
    out = A.assemble_results(merged(spark, d, known), raised, po_items(spark, d, known))
    return out.select("document_id", "po_number", F.col("vendor.name").alias("vendor_name"), "overall_confidence",
                      F.array_join("fields_flagged", ",").alias("fields_flagged"), "errors", "warnings",
                      F.size("fields").alias("n_fields"), F.col("fields")["vendor.name"]["source"].alias("vendor_source"),
                      F.array_join(F.array_sort(F.transform("flags", lambda f: f["rule"])), ",").alias("rules"), "line_items")


# --- review -----------------------------------------------------------------------------------------

CORRECTED = f"""(select document_id, field_path, coalesce(c.corrected_value, m.value) as value,
  case when c.corrected_value is not null then 1::double else m.confidence end as confidence,
  case when c.corrected_value is not null then 'human' else m.source_model end as source_model,
  coalesce(m.flagged, false) and c.corrected_value is null as flagged,
  case when c.corrected_value is null then m.review_reason end as review_reason
  from {MERGED} m full join {CORR} c using (document_id, field_path))"""


def corrected(spark, d, fields):
    return V.apply_corrections(fields.drop("disagrees"), view(spark, d, "fx_corrections"))


@query(f"select * from {CORRECTED} c")
def apply_corrections(spark, d):
    return corrected(spark, d, merged(spark, d)).drop("value_type", "raw_text")


#: the reviewed rows of documents that have a result, the flags of the records they make, and the results
REVIEWED = f"(select * from {CORRECTED} c where document_id in (select document_id from {MERGED} m))"
REVIEWED_FLAGS = ALL_FLAGS_SQL.replace(PO, f"(select *, null::varchar as vendor_country from {wide_sql('reviewed')} w)")
REVIEWED_RESULTS = f"""with reviewed as materialized {REVIEWED}, raised as materialized ({REVIEWED_FLAGS}),
  named as (select document_id, field_path from reviewed where flagged union select document_id, unnest(string_split(affected_fields, ',')) from raised where severity = 'error')
select document_id, po_number, vendor_name, c.overall_confidence, coalesce(fields_flagged, '') as fields_flagged,
  coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(rules, '') as rules, n_human
from {wide_sql('reviewed')} w
join (select document_id, round(coalesce(min(case when value is not null then confidence end), 0::double), 3) overall_confidence,
        count(*) filter (source_model = 'human') n_human from reviewed group by document_id) c using (document_id)
left join (select document_id, array_to_string(list_sort(list(field_path)), ',') fields_flagged from named group by document_id) f using (document_id)
left join (select document_id, count(*) filter (severity = 'error') errors, count(*) filter (severity = 'warning') warnings,
           string_agg("rule", ',' order by "rule") rules from raised group by document_id) s using (document_id)"""


def result_rows(fields, items, keep=lambda flags: flags):
    """Results of field rows, with the flags of the records that these rows make; ``keep`` may write these."""
    raised = keep(R.validate(A.flat_header(A.build_po(fields)), items, AS_OF))
    out = A.assemble_results(fields, raised)
    human = F.size(F.filter(F.map_values("fields"), lambda f: f["source"] == "human")).cast("long")
    return out.select("document_id", "po_number", F.col("vendor.name").alias("vendor_name"), "overall_confidence",
                      F.array_join("fields_flagged", ",").alias("fields_flagged"), "errors", "warnings",
                      F.array_join(F.array_sort(F.transform("flags", lambda f: f["rule"])), ",").alias("rules"), human.alias("n_human"))


_ALWAYS = ", ".join(f"'{p}'" for p in ("", *ALWAYS_ESCALATE))
_EXTRACTED = f"""(select document_id, field_path, case when f.confidence is not null then f.value else p.value end as value,
  coalesce(f.confidence, p.confidence) as confidence, coalesce(f.source_model, 'local') as source_model,
  coalesce({DISAGREES}, false) or case when f.confidence is not null then f.confidence < 0.75 else p.missing or p.confidence < 0.75 end as flagged
  from {fields_sql()} p left join (select * from {FALLBACK} f semi join (select document_id, field_path from {fields_sql()} p
    where confidence < 0.75 or field_path in ({_ALWAYS})) a using (document_id, field_path)) f using (document_id, field_path))"""
EXTRACTED_RESULTS = REVIEWED_RESULTS.replace(REVIEWED, _EXTRACTED).replace("'human'", "'groq'").replace("n_human", "n_second")


@query(f"""select r.*, '[' || coalesce(items, '') || ']' as line_items from ({EXTRACTED_RESULTS}) r
  left join (select document_id, string_agg({_ITEM_JSON}, ',' order by pos) items from {ITEMS} i group by document_id) i using (document_id)""")
def extracted_results(spark, d):
    """The whole way: raw replies to fields, second pass, record, the flags of that record, result."""
    known = inputs(spark, d)
    _, out = W.extract(view(spark, d, "fx_replies", known), view(spark, d, "fx_po_text", known), both_passes(spark, d, known)[1], po_items(spark, d, known), AS_OF)
    second = F.size(F.filter(F.map_values("fields"), lambda f: f["source"] == "groq")).cast("long")
    return out.select("document_id", "po_number", F.col("vendor.name").alias("vendor_name"), "overall_confidence",
                      F.array_join("fields_flagged", ",").alias("fields_flagged"), "errors", "warnings",
                      F.array_join(F.array_sort(F.transform("flags", lambda f: f["rule"])), ",").alias("rules"), second.alias("n_second"), "line_items")


@query(REVIEWED_RESULTS)
def reviewed_results(spark, d):
    """Fields after review to records, their own flags and results, in one flow."""
    known = inputs(spark, d)
    fields = merged(spark, d, known).drop("disagrees")
    # every header has field rows, so the documents that have some are those of the headers
    documents = known["fx_po"].select("document_id").distinct()
    fixes = view(spark, d, "fx_corrections").join(documents, "document_id", "left_semi")
    items = po_items(spark, d, known).join(documents, "document_id", "left_semi")
    reviewed = written_in_place(V.apply_corrections(fields, fixes), "reviewed")
    return result_rows(reviewed, items, lambda raised: written(raised, "flags"))


@query(f"""select document_id, coalesce(array_to_string(list_sort(list(field_path) filter (not done)), ','), '') as fields_remaining,
  count(*) filter (not done) = 0 as all_cleared
  from (select f.document_id, f.field_path, c.field_path is not null as done
        from {FLAGGED} f left join {CORR} c using (document_id, field_path)) x group by document_id""")
def remaining_flags(spark, d):
    known = inputs(spark, d)
    fields = merged(spark, d, known)
    flagged = A.flagged_rows(fields, flags(spark, d, known))
    out = V.remaining_flags(flagged, corrected(spark, d, fields))
    return out.withColumn("fields_remaining", F.array_join("fields_remaining", ","))


@query(f"""select m.document_id, m.field_path, value, case when ok then 1::double else confidence end as confidence,
  case when ok then 'human' else source_model end as source_model, flagged and not ok as flagged,
  case when not ok then review_reason end as review_reason
  from (select m.*, (field_path = 'vendor.name' and a.status = 'rejected') or (a.status = 'approved' and flagged) is true as ok_raw,
          coalesce((field_path = 'vendor.name' and a.status = 'rejected') or (a.status = 'approved' and flagged), false) as ok
        from {MERGED} m left join {APPR} a using (document_id)) m""")
def approve_fields(spark, d):
    """Approved documents confirm all their flagged fields, rejected ones the vendor name only."""
    decided = view(spark, d, "fx_approvals").select(
        "document_id", F.when(F.col("status") == "rejected", F.lit("vendor.name")).alias("field_path"))
    return V.approve_fields(merged(spark, d), decided).drop("value_type", "raw_text", "disagrees")


@query(f"""select c.*, m.value as original_value, m.confidence as original_confidence, m.source_model as original_source
  from {CORR} c left join {MERGED} m using (document_id, field_path)""")
def correction_history(spark, d):
    return V.correction_history(merged(spark, d), view(spark, d, "fx_corrections")).drop("raw_text")


@query(f"select user_id as result_id, max(ts) as updated_at, cast(arg_max(event_id, struct_pack(a := ts, b := event_id)) as bigint) as seq, "
       "arg_max(event_type, struct_pack(a := ts, b := event_id)) as state from events group by user_id")
def latest_result(spark, d):
    versions = table(spark, d, "events").select(
        F.col("user_id").alias("result_id"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return V.latest_results(versions)


@query(f"""select document_id, coalesce(a.status, 'pending') as status, coalesce(a.status = 'approved', false) as ready,
  case when a.status = 'approved' then '' else coalesce(pending, '') end as pending_fields,
  case when a.status = 'approved' then '' else coalesce(rules, '') end as error_rules
  from (select distinct document_id from {MERGED} m) r left join {APPR} a using (document_id)
  left join (select document_id, array_to_string(list_sort(list(field_path)), ',') pending from {FLAGGED} f group by document_id) p using (document_id)
  left join (select document_id, array_to_string(list_sort(list(distinct split_part("rule", ':', 1))), ',') rules
             from ({ALL_FLAGS_SQL}) f where severity = 'error' group by document_id) e using (document_id)""")
def export_gate(spark, d):
    known = inputs(spark, d)
    fields, raised = merged(spark, d, known), stored(flags(spark, d, known), "flags")
    flagged = A.overall_confidence(fields).join(A.flagged_fields(fields, raised), "document_id", "left")
    out = V.export_gate(flagged, view(spark, d, "fx_approvals"), raised)
    return out.withColumns({c: F.array_join(c, ",") for c in ("pending_fields", "error_rules")})


# --- exports -------------------------------------------------------------------------------------------

def po_items(spark, d, known=None):
    return view(spark, d, "fx_items", known).drop("suppkey", "ship_date")


def records(spark, d, known=None):
    """Orders as nested records with the reviewers' values."""
    return E.apply_corrections(A.nest_header(view(spark, d, "fx_po", known)), view(spark, d, "fx_corrections"))


RECORD = f"""(select po.* replace (coalesce(c.corrected_value, vendor_name) as vendor_name), s.corrected_value as ship_to from {PO} po
  left join (select * from {CORR} c where field_path = 'vendor.name') c using (document_id)
  left join (select * from {CORR} c where field_path = 'ship_to') s using (document_id))"""


_VENDOR_JSON = _pairs(("name", "vendor_name", js("vendor_name")), ("country", "vendor_country", js("vendor_country")),
                      ("email", "vendor_email", js("vendor_email")))
_TOTALS_JSON = _pairs(("subtotal", "subtotal", "cast(subtotal as varchar)"), ("shipping", "shipping", "cast(shipping as varchar)"),
                      ("grand_total", "grand_total", "cast(grand_total as varchar)"))
_PO_JSON = _pairs(
    ("po_number", "po_number", js("po_number")), ("po_date", "po_date", js("po_date")), ("due_date", "due_date", js("due_date")),
    ("payment_terms", "payment_terms", js("payment_terms")), ("currency", "currency", js("currency")),
    ("vendor", "coalesce(vendor_name, vendor_country, vendor_email)", _VENDOR_JSON),
    ("buyer", "buyer_name", "'{\"name\":' || " + js("buyer_name") + " || '}'"),
    ("ship_to", "ship_to", js("ship_to")), ("line_items", "1", "'[' || coalesce(items, '') || ']'"),
    ("totals", "coalesce(subtotal, shipping, grand_total)", _TOTALS_JSON))
BODIES = f"""(select document_id, {_PO_JSON} as body from {RECORD} r left join (
  select document_id, string_agg({_ITEM_JSON}, ',' order by pos) items from {ITEMS} i group by document_id) i using (document_id))"""


@query(f"select * from {BODIES} b")
def export_json(spark, d):
    known = inputs(spark, d)
    return E.export_json(records(spark, d, known), po_items(spark, d, known))


_META = f"""(select document_id, '{{"result_id":"r' || document_id || '","document_id":"' || document_id || '","overall_confidence":'
    || {num("round(coalesce(min(case when value is not null then confidence end), 0::double), 3)")} || ',"primary_model":"local","fallback_triggered":'
    || bool_or(source_model = 'groq') || ',"exported_at":"{AS_OF}"'
    || coalesce(',"field_confidence":{{' || string_agg('"' || field_path || '":{{"value":' || {js('value')} || ',"confidence":' || {num('round(confidence, 3)')}
       || ',"source":"' || source_model || '"}}', ',' order by field_path) filter (value is not null) || '}}', '') || '}}' as meta
  from {MERGED} m group by document_id)""".replace("{{", "{").replace("}}", "}")


@query(f"""select document_id, body[:-2] || ',"_metadata":' || meta || '}}' as body from (
    select document_id, {_PO_JSON.replace("coalesce(subtotal, shipping, grand_total)", "has_totals")} as body
    from (select *, null::varchar vendor_country, null::varchar ship_to from {WIDE} w) r
    join (select document_id, case when bool_or(value is not null) filter (field_path like 'totals.%') then true end has_totals
      from {MERGED} m group by document_id) t using (document_id)
    left join (select document_id, string_agg({_ITEM_JSON}, ',' order by pos) items from {ITEMS} i group by document_id) i using (document_id)) b
  join {_META} m using (document_id)""")
def export_json_metadata(spark, d):
    """Extracted records with the block that says where every value comes from; totals that were given but not read are ``{}``."""
    known = inputs(spark, d)
    fields = merged(spark, d, known)
    ran = fields.groupBy("document_id").agg(F.bool_or(F.col("source_model") == "groq").alias("fallback_triggered"))
    about = A.overall_confidence(fields).join(ran, "document_id").withColumns(
        {"result_id": F.concat(F.lit("r"), F.col("document_id")), "primary_model": F.lit("local")})
    return E.export_json(A.build_po(fields), po_items(spark, d, known), E.json_metadata(about, fields, AS_OF))


def _txt(c: str) -> str:
    return f"coalesce({c}, '')"


@query(f"""select document_id, coalesce(pos, -1) as pos, {_txt('po_number')} po_number, {_txt('po_date')} po_date, {_txt('due_date')} due_date,
  {_txt('payment_terms')} payment_terms, '' delivery_terms, {_txt('r.currency')} currency, {_txt('vendor_name')} vendor_name, '' vendor_address,
  '' vendor_city, {_txt('vendor_country')} vendor_country, {_txt('vendor_email')} vendor_email, '' vendor_phone, '' vendor_tax_id,
  {_txt('buyer_name')} buyer_name, '' buyer_department, '' buyer_contact_person, {_txt(num('subtotal'))} total_subtotal, '' total_tax,
  {_txt(num('shipping'))} total_shipping, '' total_discount, {_txt(num('grand_total'))} total_grand,
  {_txt('cast(pos + 1 as varchar)')} line_number, {_txt('description')} line_description, {_txt('part_number')} part_number,
  {_txt(num('quantity'))} quantity, '' unit, {_txt(num('unit_price'))} unit_price, {_txt(num('line_total'))} line_total,
  {_txt('i.currency')} line_currency, {_txt(num('tax_rate'))} tax_rate
  from {RECORD} r left join {ITEMS} i using (document_id)""")
def export_csv(spark, d):
    return E.export_csv(A.flat_header(records(spark, d)), po_items(spark, d))


@query(f"""select r.document_id, po_number, vendor_name, buyer_name, {num('grand_total')} as grand_total, n_items,
  last_description, {num('item_total')} as item_total
  from {RECORD} r left join (select document_id, cast(count(*) as varchar) n_items, arg_max(description, pos) last_description,
    cast(sum(cast(line_total as decimal(18,2))) as double) item_total from {ITEMS} i group by document_id) i using (document_id)""")
def export_xml(spark, d):
    """The XML text read back with ``from_xml``."""
    schema = ("Header struct<PONumber:string,Vendor:struct<Name:string>,Buyer:struct<Name:string>>, Totals struct<GrandTotal:string>, "
              "LineItems struct<_count:string,LineItem:array<struct<_index:string,Description:string,LineTotal:string>>>")
    back = E.export_xml(records(spark, d), po_items(spark, d)).withColumn("x", F.from_xml("body", schema))
    items = F.col("x.LineItems.LineItem")
    total = F.aggregate(F.transform(items, lambda i: F.coalesce(i["LineTotal"].cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))),
                        F.lit(0).cast("decimal(28,2)"), lambda a, v: (a + v).cast("decimal(28,2)"))
    any_total = F.exists(items, lambda i: i["LineTotal"].isNotNull())
    return back.select(
        "document_id", F.col("x.Header.PONumber").alias("po_number"), F.col("x.Header.Vendor.Name").alias("vendor_name"),
        F.col("x.Header.Buyer.Name").alias("buyer_name"), F.col("x.Totals.GrandTotal").alias("grand_total"),
        F.col("x.LineItems._count").alias("n_items"), F.element_at(items, -1)["Description"].alias("last_description"),
        E.number_text(F.when(any_total, total).cast("double")).alias("item_total"))


SECRET = "outbox-test-secret"
_KEY = SECRET.encode().ljust(64, b"\0")
_PAD = lambda x: "".join(f"\\x{b ^ x:02X}" for b in _KEY)
_PAYLOAD = (f"'{{\"event\":\"po.extracted\",\"timestamp\":\"{AS_OF}T00:00:00Z\",\"result_id\":\"' || document_id || '\",\"document_id\":\"' "
            "|| document_id || '\",\"po_data\":' || body || ',\"ready_for_processing\":true}'").replace("{{", "{")


@query(f"""select document_id, payload,
  'sha256=' || sha256('{_PAD(0x5C)}'::blob || unhex(sha256('{_PAD(0x36)}'::blob || encode(payload)))) as signature
  from (select document_id, {_PAYLOAD} as payload from {BODIES} b where document_id in (
    select document_id from {APPR} a where status = 'approved')) p""")
def webhook_outbox(spark, d):
    decided = V.current_approval(view(spark, d, "fx_approvals"))
    return E.webhook_outbox(records(spark, d), po_items(spark, d), decided, SECRET, f"{AS_OF}T00:00:00Z")


# --- jobs ------------------------------------------------------------------------------------------------

STATE = f"""(select job_id, arg_max(status, struct_pack(a := ts, b := seq)) status, min(ts) created_at, max(ts) updated_at,
  max(ts) filter (status = 'complete') completed_at, count(*) n_events from {JOBS} j group by job_id)"""


@query(f"select * from {STATE} s")
def job_state(spark, d):
    return J.current_jobs(view(spark, d, "fx_jobs"))


@query(f"""select s.*, o_totalprice as amount, o_orderstatus as result_status from {STATE} s left join orders on o_orderkey = job_id
  order by created_at desc, job_id desc limit 100""")
def jobs_dashboard(spark, d):
    found = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("result_status"))
    return J.jobs_dashboard(J.current_jobs(view(spark, d, "fx_jobs")), found)


@query(f"""select job_id, seq, ts, status, lag(status) over w as previous_status, lead(status) over w as next_status, lead(ts) over w as next_ts
  from {JOBS} j window w as (partition by job_id order by ts, seq)""")
def job_transitions(spark, d):
    return J.job_transitions(view(spark, d, "fx_jobs"))


END = "2024-02-01 00:00:00"


@query(f"""select job_id, seq, (epoch_us(coalesce(next_ts, timestamp '{END}')) - epoch_us(ts)) / 1000000::double as lasted_seconds,
  'failed' as status, 'Timed out after 600s.' as error_message
  from (select *, lead(ts) over (partition by job_id order by ts, seq) next_ts from {JOBS} j) x
  where status = 'processing' and epoch_us(coalesce(next_ts, timestamp '{END}')) - epoch_us(ts) > 600000000""")
def job_timeouts(spark, d):
    return J.job_timeouts(view(spark, d, "fx_jobs"), END)


# --- files and mail -----------------------------------------------------------------------------------------

_ALLOWED = "(" + ", ".join(f"'{m}'" for m in ALLOWED_MIME_TYPES) + ")"
ADMITTED = f"""(select *, case when size_bytes > 20971520 then 'too large' when size_bytes = 0 then 'empty'
    when declared_type not in {_ALLOWED} then 'declared type not allowed' when detected_type is null then 'content not recognised' end as reject_reason
  from (select *, case when declared_mime <> 'application/octet-stream' then declared_mime else coalesce(
      case lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) when '.pdf' then 'application/pdf' when '.jpg' then 'image/jpeg'
        when '.jpeg' then 'image/jpeg' when '.png' then 'image/png' when '.tiff' then 'image/tiff' when '.tif' then 'image/tiff'
        when '.webp' then 'image/webp' end, declared_mime) end as declared_type,
    case when starts_with(header_hex, '25504446') then 'application/pdf' when starts_with(header_hex, 'FFD8FF') then 'image/jpeg'
      when starts_with(header_hex, '89504E470D0A1A0A') then 'image/png' when starts_with(header_hex, '49492A00') then 'image/tiff'
      when starts_with(header_hex, '4D4D002A') then 'image/tiff'
      when starts_with(header_hex, '52494646') and substring(header_hex, 17, 8) = '57454250' then 'image/webp' end as detected_type
    from {FILES} f) t)"""


@query(f"select *, reject_reason is null and declared_type <> detected_type as mime_mismatch from {ADMITTED} a")
def file_admission(spark, d):
    return S.admit_files(view(spark, d, "fx_files"))


@query(f"""select message_id, part_no, sender, subject, disposition, filename, lower(mime_type) as mime_type, size_bytes,
  case when not contains(lower(subject), 'order') then 'subject does not match'
    when not contains(lower(disposition), 'attachment') then 'not an attachment' when coalesce(filename, '') = '' then 'no file name'
    when lower(mime_type) not in {_ALLOWED} then 'type not allowed' when size_bytes = 0 then 'empty'
    when size_bytes > 20971520 then 'too large' end as reject_reason from {MAIL} m""")
def attachment_admission(spark, d):
    return S.admit_attachments(view(spark, d, "fx_mail"), subject_filter="Order")


# --- streams --------------------------------------------------------------------------------------------------

def _stream_view(spark, d, name, table):
    """A view over one base table, with that table read as a stream."""
    return spark.sql(sql_text(name), **{table: ST.read_table(spark, d, f"{table}.parquet")})


@query(f"""select doc_id, filename, declared_type, detected_type, reject_reason,
  case when reject_reason is null then 'pending' else 'failed' end as job_status from {ADMITTED} a""")
def stream_ingest(spark, d):
    folder, _ = ST.run_available(ST.ingest(_stream_view(spark, d, "fx_files", "documents")), "ingest")
    return ST.read_back(spark, folder).select("doc_id", "filename", "declared_type", "detected_type", "reject_reason", "job_status")


@query(f"select * from {STATE} s")
def stream_jobs(spark, d):
    folder, _ = ST.fold_jobs(_stream_view(spark, d, "fx_jobs", "events"))
    return J.merge_jobs(ST.read_back(spark, folder))


@query(f"select * from {STATE} s")
def stream_jobs_out_of_order(spark, d):
    """Events delivered in two runs of one checkpoint, odd ones first."""
    base = f"{work_dir(spark)}/disorder-{uuid.uuid4().hex}"
    events = view(spark, d, "fx_jobs")
    for part in (1, 0):
        events.filter(F.col("seq") % 2 == part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        folder, _ = ST.fold_jobs(stream, folder=f"{base}/out")
    return J.merge_jobs(ST.read_back(spark, folder))


@query(f"select seq, count(*) as n from {JOBS} j group by seq")
def stream_dedupe(spark, d):
    """Every event is delivered twice; one copy is kept."""
    events = _stream_view(spark, d, "fx_jobs", "events")
    twice = events.union(events)
    folder, _ = ST.fold_dedupe(twice, ["seq"])
    return ST.first_rows(ST.read_back(spark, folder), ["seq"]).groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


@query(f"select seq, job_id, status from {JOBS} j")
def stream_dedupe_out_of_order(spark, d):
    """Events delivered newest stretch first in runs of one checkpoint, with every third one again at the end."""
    base = f"{work_dir(spark)}/repeats-{uuid.uuid4().hex}"
    events = view(spark, d, "fx_jobs")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(low + (high - low) / 2)
    for part in (events.filter(F.col("ts") >= middle), events.filter(F.col("ts") < middle), events.filter(F.col("seq") % 3 == 0)):
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        folder, _ = ST.fold_dedupe(stream, ["seq"], folder=f"{base}/out")
    return ST.first_rows(ST.read_back(spark, folder), ["seq"]).select("seq", "job_id", "status")


@query(f"select document_id, field_path, corrected_value, reviewer_id, seq from {CORR} c")
def stream_corrections(spark, d):
    stream = _stream_view(spark, d, "fx_corrections", "labels")
    folder, _ = ST.upsert_corrections(stream)
    return ST.read_back(spark, folder, keys=["document_id", "field_path"], order=("seq",))


@query(REVIEWED_RESULTS)
def stream_results(spark, d):
    """Results kept up to date by three batches of corrections, odd ones first."""
    base = f"{work_dir(spark)}/maintained-{uuid.uuid4().hex}"
    known = inputs(spark, d)
    first = lambda fields, items: result_rows(fields, items, lambda raised: written(raised, "flags"))
    MT.prepare(merged(spark, d, known).drop("disagrees"), po_items(spark, d, known), first, base)
    fixes = view(spark, d, "fx_corrections")
    for part in (1, 2, 0):
        fixes.filter(F.col("seq") % 3 == part).write.mode("append").parquet(f"{base}/in/part={part}")
        stream = spark.readStream.schema(fixes.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        MT.maintain(stream, result_rows, base)
    return MT.current_results(spark, base)


@query(f"""select job_id, seq, status, null as error_message from {JOBS} j
  union all select job_id, seq, 'failed', 'Timed out after 600s.' from (
    select *, lead(ts) over (partition by job_id order by ts, seq) next_ts from {JOBS} j) x
  where status = 'processing' and epoch_ms(next_ts) - epoch_ms(ts) > 600000""")
def stream_job_tracker(spark, d):
    """State changes and timeouts from keyed state with expiry."""
    folder, _ = ST.run_available(ST.track_jobs(_stream_view(spark, d, "fx_jobs", "events")), "tracker", one_batch=True)
    return ST.read_back(spark, folder)
