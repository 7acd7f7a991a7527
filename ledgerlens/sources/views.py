"""Test inputs derived from the given tables.

Each view is one SQL text that Spark and DuckDB both accept, so the engine and
the check see the same rows. ``{orders}`` and the like name the base tables.
Arithmetic only: no hashes, no randomness, no clock.
"""

from __future__ import annotations

from collections.abc import Container

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators.frames import spread, stored, written

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "labels", "conversations",
)

#: reference day for the date rules (the rules take it as a parameter)
AS_OF = "2008-06-30"

VIEWS: dict[str, str] = {}

# line items of every order; duplicates of a line number get their own position
VIEWS["fx_items"] = """
select l_orderkey as document_id,
       cast(row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 as int) as pos,
       p_name as description,
       cast(l_partkey as string) as part_number,
       l_quantity as quantity,
       case when l_partkey % 2 = 0
            then floor(l_extendedprice / l_quantity * 100 + cast(0.5 as double)) / cast(100 as double)
            else p_retailprice end as unit_price,
       case when l_partkey % 29 = 0 then null else l_extendedprice end as line_total,
       l_tax as tax_rate,
       case when l_suppkey % 31 = 0 then 'EUR' else 'USD' end as currency,
       l_suppkey as suppkey,
       cast(l_shipdate as date) as ship_date
from {lineitem} left join {part} on p_partkey = l_partkey
"""

# one flat purchase-order header per order
VIEWS["fx_po"] = """
select o_orderkey as document_id,
       case when o_orderkey % 97 = 0 then null when o_orderkey % 89 = 0 then '###'
            else 'PO-' || cast(o_orderkey as string) end as po_number,
       case when o_orderkey % 53 = 0 then 'Jan 15, 2024' when o_orderkey % 47 = 0 then null
            when o_orderkey % 43 = 0 then '2009/1/5'
            else cast(cast(o_orderdate as date) as string) end as po_date,
       cast(due as string) as due_date,
       case when o_orderkey % 7 = 0 then 'Paid in part' when o_orderkey % 7 = 1 then 'Deposit 20%'
            else 'Net 30' end as payment_terms,
       case when o_orderkey % 61 = 0 then null else s_name end as vendor_name,
       case when o_orderkey % 41 = 0 then 'not-an-email'
            else lower(replace(s_name, '#', '.')) || '@example.com' end as vendor_email,
       n_name as vendor_country,
       c_name as buyer_name,
       case when o_orderkey % 59 = 0 then 'gbp' else 'USD' end as currency,
       case when o_orderkey % 3 = 0 then o_totalprice else s end as subtotal,
       case when o_orderkey % 5 = 0 then cast(10.0 as double) end as shipping,
       case when o_orderkey % 37 = 0 then null when o_orderkey % 3 = 1 then s
            when o_orderkey % 3 = 2 then round(s * 0.73, 4) else o_totalprice end as grand_total
from {orders}
left join (select l_orderkey,
                  cast(sum(case when l_partkey % 29 = 0 then null
                           else cast(l_extendedprice as decimal(28,6)) end) as double) as s,
                  max(cast(l_shipdate as date)) as due, min(l_suppkey) as sk
           from {lineitem} group by l_orderkey) a on l_orderkey = o_orderkey
left join {supplier} on s_suppkey = sk
left join {nation} on n_nationkey = s_nationkey
left join {customer} on c_custkey = o_custkey
"""

def _cents(c: str) -> str:
    """Two-decimal text, rounded in double arithmetic so both engines agree on halves."""
    return f"cast(cast(cast(floor({c} * 100 + cast(0.5 as double)) as bigint) / cast(100 as double) as decimal(18,2)) as string)"


_PATHS = (
    ("po_number", "po_number"), ("po_date", "po_date"), ("due_date", "due_date"),
    ("payment_terms", "payment_terms"), ("currency", "currency"), ("vendor.name", "vendor_name"),
    ("vendor.email", "vendor_email"), ("buyer.name", "buyer_name"),
    ("totals.subtotal", _cents("subtotal")),
    ("totals.shipping", _cents("shipping")),
    ("totals.grand_total", _cents("grand_total")),
)
_LONG = (
    "select document_id, k, case k "
    + " ".join(f"when {k} then '{path}'" for k, (path, _) in enumerate(_PATHS, 1))
    + " end as field_path, case k "
    + " ".join(f"when {k} then {expr}" for k, (_, expr) in enumerate(_PATHS, 1))
    + " end as value from (select *, [one_to_eleven] as k from ({fx_po}) po) numbered"
)

# first extraction pass, long form; of some documents nothing could be read
VIEWS["fx_primary"] = f"""
select document_id, k, field_path, value,
       case when value is null then cast(0 as double)
            else cast((document_id * 7 + k * 13) % 101 as double) / cast(100 as double) end as confidence,
       'local' as source_model
from (select document_id, k, field_path, case when document_id % 113 = 0 then null else value end as value from ({_LONG}) long_fields) l
"""

# second pass: only what the first left under the threshold
VIEWS["fx_fallback"] = """
select document_id, k, field_path,
       case when (document_id + k) % 9 = 0 then value || ' x'
            when (document_id + k) % 4 = 0 then upper(value) else value end as value,
       cast(60 + (document_id * 11 + k * 5) % 41 as double) / cast(100 as double) as confidence,
       'groq' as source_model
from ({fx_primary}) first_pass where confidence < 0.75
"""

# raw model replies in the shapes a model produces; « and » stand for literal braces
VIEWS["fx_replies"] = """
select document_id,
       case document_id % 6
            when 0 then body || '»'
            when 1 then 'Sure.' || chr(10) || '```json' || chr(10) || body || '»' || chr(10) || '```'
            when 2 then 'Here it is: ' || body || '» Anything else? «no»'
            when 3 then substring(body, 1, length(body) - 11)
            when 4 then body || ', "currency": "' || currency || '"»'
            else body || ', "x": »' end as raw_response
from (select document_id, currency,
             '«"po_number": «"value": "' || coalesce(po_number, 'none') || '", "confidence": '
             || cast(document_id % 101 as string) || '», "po_date": null, '
             || '"vendor.name": «"value": "' || coalesce(vendor_name, '') || '", "confidence": "'
             || cast(cast((document_id * 3) % 150 as double) / cast(100 as double) as string) || '"», '
             || '"payment_terms": "' || payment_terms || '", '
             || '"totals.grand_total": «"value": '
             || coalesce([grand_total], 'null')
             || ', "confidence": "high"»' as body
      from ({fx_po}) po) built
"""

# the text a reply was read from; odd keys leave the vendor out
VIEWS["fx_po_text"] = """
select document_id,
       'Order ' || coalesce(po_number, '') || chr(10) || 'Date ' || coalesce(po_date, '') || chr(10) ||
       'Due ' || coalesce(due_date, '') || chr(10) || 'Terms ' || payment_terms || chr(10) ||
       case when document_id % 2 = 1 then '' else 'From ' || coalesce(vendor_name, '') || chr(10) end ||
       'Buyer ' || coalesce(buyer_name, '') || chr(10) ||
       'Total ' || coalesce([grand_total], '') || ' ' || currency as ocr_text
from ({fx_po}) po
"""

# item arrays as a model returns them, one reply per order line
VIEWS["fx_item_replies"] = """
select l_orderkey as document_id, l_linenumber as line_no, l_partkey as partkey, l_suppkey as suppkey,
       l_extendedprice as price,
       case l_partkey % 8
         when 0 then '[«' || item || '»]'
         when 1 then '«' || item || ', "colour": "red"»'
         when 2 then '[«"description": «"value": "' || p_name || '", "confidence": 0.9», "quantity": «"value": "'
                     || cast(l_quantity as string) || '", "confidence": 0.5», "line_number": 3»]'
         when 3 then '[«"description": "' || p_name
                     || '", "quantity": "5 pcs", "unit_price": "$1,234.50", "currency": "USD"»]'
         when 4 then '[«"part_number": "' || cast(l_partkey as string) || '"»]'
         when 5 then '[«"description": "' || p_name || '", "quantity": -1», «' || item || '»]'
         when 6 then '["text", «"description": "' || p_name || '", "tax_rate": 18», «' || item || '»]'
         else '"not a list"' end as raw
from (select l.*, p_name,
             '"description": "' || p_name || '", "part_number": "' || cast(l_partkey as string)
             || '", "quantity": ' || cast(l_quantity as string)
             || ', "line_total": ' || cast(l_extendedprice as string)
             || ', "tax_rate": ' || cast(l_tax as string) as item
      from {lineitem} l join {part} on p_partkey = l_partkey) t
"""

# run cost of each pass
VIEWS["fx_calls"] = """
select cast(floor(event_id / 4) as bigint) as document_id,
       case when event_type in ('view', 'click') then 'fallback' else 'primary' end as pass,
       event_id as seq,
       cast(floor(value * 100) as int) as latency_ms,
       case when event_type = 'signup' then null else cast(floor(value * 7) as int) end as prompt_tokens,
       case when event_type = 'error' then null else cast(floor(value) as int) end as completion_tokens,
       case when event_type in ('error', 'view') then 'bad reply ' || cast(event_id % 3 as string) end as parse_error
from {events}
"""

# review events
VIEWS["fx_corrections"] = """
select doc_id as document_id,
       case when doc_id % 2 = 0 then 'vendor.name' else 'ship_to' end as field_path,
       'Corrected ' || cast(doc_id as string) as corrected_value,
       'reviewer-' || cast(doc_id % 3 as string) as reviewer_id,
       doc_id as seq
from {labels} where quality = 0
"""
VIEWS["fx_approvals"] = """
select doc_id as document_id,
       case when toxic = 0 then 'approved' else 'rejected' end as status,
       doc_id as seq
from {labels}
"""

# job lifecycle events; ``seq`` breaks ties between equal times
VIEWS["fx_jobs"] = """
select user_id as job_id, event_id as seq, ts,
       case event_type when 'signup' then 'pending' when 'view' then 'processing'
            when 'purchase' then 'complete' else 'failed' end as status
from {events} where event_type <> 'click'
"""

# provider probes and the moments at which documents ask for a provider
VIEWS["fx_health"] = """
select case when value < 50 then 'local' else 'groq' end as provider, ts, event_type = 'view' as ok, event_id as seq
from {events} where event_type in ('view', 'error')
"""
VIEWS["fx_requests"] = """
select event_id as document_id, ts from {events} where event_type in ('signup', 'click', 'purchase')
"""

# uploaded files: header bytes by kind, some empty, some too large
VIEWS["fx_files"] = """
select doc_id,
       'scan ' || cast(doc_id as string) || case doc_id % 5 when 0 then '.pdf' when 1 then '.JPG'
            when 2 then '.png' when 3 then '.webp' else '.txt' end as filename,
       case doc_id % 4 when 0 then 'application/octet-stream' when 1 then 'application/pdf'
            when 2 then 'image/png' else 'text/plain' end as declared_mime,
       case doc_id % 7 when 0 then '255044462D312E37' when 1 then 'FFD8FFE000104A46' when 2 then '89504E470D0A1A0A0000'
            when 3 then '49492A0008000000' when 4 then '524946460000000057454250' when 5 then '524946460000000041564920'
            else '' end as header_hex,
       case when doc_id % 7 = 6 then cast(0 as bigint) when doc_id % 41 = 0 then cast(20971521 as bigint)
            else n_chars end as size_bytes
from {documents}
"""

# message parts of a mailbox
VIEWS["fx_mail"] = """
select conv_id as message_id, turn as part_no,
       role || '@example.com' as sender,
       case when conv_id % 3 = 0 then 'Purchase ORDER ' || cast(conv_id as string)
            else 'Note ' || cast(conv_id as string) end as subject,
       case turn % 3 when 0 then 'attachment; filename=x' when 1 then 'inline' else 'ATTACHMENT' end as disposition,
       case when turn % 5 = 4 then null else 'file' || cast(turn as string) || '.pdf' end as filename,
       case (conv_id + turn) % 4 when 0 then 'application/pdf' when 1 then 'Image/PNG'
            when 2 then 'text/html' else 'image/tiff' end as mime_type,
       case when conv_id % 11 = 0 then cast(0 as bigint) else cast(length(text) * 90000 as bigint) end as size_bytes
from {conversations}
"""


# cells of the item table of a purchase order: five text lines per item row, in pixels
VIEWS["fx_po_lines"] = """
select document_id, cast(floor(pos / 40) as int) + 1 as page, pos * 5 + cell as line_idx, text,
       cast(72 + cell * 120 as double) as x0, cast(72 + 18 * (pos % 40) as double) as y0,
       cast(72 + cell * 120 + 6 * length(text) as double) as x1, cast(86 + 18 * (pos % 40) as double) as y1,
       cast(0.9 as double) as ocr_confidence
from (select document_id, pos, cell,
             case cell when 0 then description when 1 then part_number
                  when 2 then cast(quantity as string) || ' pcs' when 3 then '$ ' || cast(unit_price as string)
                  else cast(line_total as string) || ' USD' end as text
      from (select *, [zero_to_four] as cell from ({fx_items}) i) c) t
where text is not null
"""

#: shorthands, among them the construct the two dialects spell differently
_DIALECT = {
    "[grand_total]": dict.fromkeys(("spark", "duck"), _cents("grand_total")),
    "[zero_to_four]": {"spark": "explode(sequence(0, 4))", "duck": "unnest(range(0, 5))"},
    "[one_to_eleven]": {"spark": "explode(sequence(1, 11))", "duck": "unnest(range(1, 12))"},
}


def sql_text(name: str, dialect: str = "spark", known: Container[str] = ()) -> str:
    """View text with nested views expanded and only base tables, and views that are ``known``, left as ``{name}``."""
    text = VIEWS[name].replace("«", "{{").replace("»", "}}")
    for token, spelled in _DIALECT.items():
        text = text.replace(token, spelled[dialect])
    for other in VIEWS:
        if other not in known and "{" + other + "}" in text:
            text = text.replace("{" + other + "}", sql_text(other, dialect, known))
    return text


def duck(name: str) -> str:
    """The view as a DuckDB subquery over tables of the plain names."""
    return "(" + sql_text(name, "duck").format(**{t: t for t in TABLES}) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """The view over the tables; views that are ``known`` (see :func:`prepared`) are read and not built again."""
    known = known or {}
    if name in known:
        return known[name]
    text = sql_text(name, known=known)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used, **{v: df for v, df in known.items() if "{" + v + "}" in text})


def prepared(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Views that several steps of a query read, written once."""
    return {n: stored(view(spark, sf_dir, n), n) for n in names}


def prepared_by_document(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Headers and items, dealt out by document once: what joins or groups them by document shuffles nothing."""
    # the numbers of the items are given document by document, so these lie together already
    return {"fx_po": written(spread(view(spark, sf_dir, "fx_po"), "document_id"), "fx_po"),
            "fx_items": written(view(spark, sf_dir, "fx_items"), "fx_items")}
