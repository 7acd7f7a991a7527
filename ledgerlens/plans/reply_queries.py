"""Prompts, replies and the two extraction passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ledgerlens.catalog import REQUESTED
from ledgerlens.operators import passes as P, replies as R
from ledgerlens.operators.frames import spread, written_in_place
from ledgerlens.plans.registry import query
from ledgerlens.plans.rule_queries import NUM
from ledgerlens.sources.views import duck, prepared, table, view

REPLIES, TEXTS = duck("fx_replies"), duck("fx_po_text")
PRIMARY, FALLBACK = duck("fx_primary"), duck("fx_fallback")
CALLS, HEALTH, REQUESTS = duck("fx_calls"), duck("fx_health"), duck("fx_requests")

_ABOUT = ", ".join(f"{{'path': '{f.path}', 'about': '{f.description.replace(chr(39), chr(39) * 2)}'}}" for f in REQUESTED)


@query(f"""select document_id, len(entries) as n_fields,
  'Read the purchase order below and return one JSON object, nothing else. Find out the language of the text.'
  || ' Give values as printed and null for what is absent.' || chr(10) || '{{' || chr(10)
  || array_to_string(list_transform(entries, lambda e: '  "' || e.path || '": {{"value": ..., "confidence": 0.0-1.0}}  // ' || e.about), chr(10))
  || chr(10) || '}}' || chr(10) || '---' || chr(10) || ocr_text || chr(10) || '---' as prompt
  from (select t.document_id, ocr_text, list_filter([{_ABOUT}], lambda e: list_contains(paths, e.path)) as entries
        from {TEXTS} t join (select document_id, list(distinct field_path) paths from {PRIMARY} p
                             where confidence < 0.75 group by document_id) w using (document_id)) x""".replace("{{", "{").replace("}}", "}"))
def prompt_table(spark, d):
    targets = P.escalation_set(view(spark, d, "fx_primary"))
    return R.prompt_table(view(spark, d, "fx_po_text"), targets)


_CLEAN = f"""(select document_id, raw_response, body, walk, outer_part,
  regexp_replace(coalesce(walk, body), ',[^,]*$', chr(10) || '}}') as cut
  from (select *, regexp_extract(body, '(?s)^(.*\\}})', 1) outer_part,
    substring(body, 1, list_min(list_filter(range(1, length(body) + 1), lambda p: substring(body, p, 1) = '}}'
      and length(replace(substring(body, 1, p), '{{', '')) = length(replace(substring(body, 1, p), '}}', ''))))) walk
    from (select *, substring(txt, nullif(instr(txt, '{{'), 0)) body
      from (select *, coalesce(nullif(regexp_extract(trim(raw_response), '```(?:json)?\\s*([\\s\\S]+?)\\s*```', 1, 'i'), ''),
            trim(raw_response)) txt from {REPLIES} r) a) b) c)""".replace("{{", "{").replace("}}", "}")
CLEANED = f"""(select document_id, raw_response,
  case when json_valid(walk) then walk when json_valid(outer_part) then outer_part when json_valid(cut) then cut end as reply_json,
  case when json_valid(walk) or json_valid(outer_part) then 'clean' when json_valid(cut) then 'recovered' else 'failed' end as reply_status
  from {_CLEAN} c)"""


@query(f"select document_id, reply_json, reply_status from {CLEANED} c")
def reply_json(spark, d):
    return R.clean_replies(view(spark, d, "fx_replies")).drop("raw_response", "reply_map")


@query(f"select reply_status, count(*) as n, sum(length(reply_json)) as n_chars from {CLEANED} c group by reply_status")
def reply_recovery(spark, d):
    """How often each way of reading a reply was needed."""
    cleaned = R.clean_replies(view(spark, d, "fx_replies"))
    return cleaned.groupBy("reply_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("reply_json")).alias("n_chars"))


def boosted(value: str, conf: str, text: str) -> str:
    """Evidence boost in SQL."""
    words = f"list_filter(string_split_regex(lower(replace(trim({value}), ',', ' ')), '\\s+'), lambda w: length(w) >= 3)"
    return f"""case when {value} is null or length(trim({value})) < 3 or {text} is null then {conf}
      when contains({text}, lower(trim({value}))) then least(0.95::double, {conf} + 0.15::double)
      when len({words}) > 0 and 2 * len(list_filter({words}, lambda w: contains({text}, w))) >= len({words})
      then least(0.92::double, {conf} + 0.08::double) else {conf} end"""


_PATHS = ", ".join(f"'{f.path}'" for f in REQUESTED)
_FIELDS = f"""(select document_id, field_path, missing, value, value_type,
  case when missing then 0::double when value_type in ('string', 'number', 'boolean') then {boosted('value', 'conf', 'txt')}
       else conf end as confidence
  from (select document_id, field_path, txt, shape is null or shape = 'NULL' as missing,
     case when kind = 'NULL' or kind is null then null when kind = 'DOUBLE'
          then regexp_replace(regexp_replace(inner_text, '0+$', ''), '\\.$', '') else inner_text end as value,
     case when kind is null or kind = 'NULL' then 'null' when kind = 'VARCHAR' then 'string' when kind = 'OBJECT' then 'object'
          when kind = 'ARRAY' then 'array' when kind = 'BOOLEAN' then 'boolean' else 'number' end as value_type,
     case when shape <> 'OBJECT' then 0.7::double when stated is null or not regexp_full_match(stated, '{NUM}') then 0.5::double
          when try_cast(stated as double) > 1 then least(1::double, try_cast(stated as double) / 100::double)
          else greatest(0::double, try_cast(stated as double)) end as conf
   from (select document_id, field_path, txt, json_type(raw) shape,
        case when json_type(raw) = 'OBJECT' then json_type(raw, '$.value') else json_type(raw) end kind,
        case when json_type(raw) = 'OBJECT' then raw ->> '$.value' else raw ->> '$' end inner_text,
        raw ->> '$.confidence' stated
      from (select document_id, field_path, txt, json_extract(cast(reply_json as json), '$."' || field_path || '"') raw
        from (select c.document_id, reply_json, lower(ocr_text) txt, unnest([{_PATHS}]) field_path
              from {CLEANED} c left join {TEXTS} t on t.document_id = c.document_id) a) b) e) f)"""


def fields_sql() -> str:
    """Field rows of the replies, for the checks of later steps."""
    return _FIELDS


@query(f"""select document_id, field_path, value, value_type, confidence, missing or confidence < 0.75 as flagged,
  case when missing then 'missing_required' when confidence < 0.75 then 'low_confidence' end as review_reason
  from {_FIELDS} f""")
def reply_fields(spark, d):
    known = prepared(spark, d, "fx_po")
    cleaned = R.clean_replies(view(spark, d, "fx_replies", known))
    fields = R.reply_fields(cleaned, view(spark, d, "fx_po_text", known))
    return fields.drop("source_model", "parse_note")


@query(f"""select p.document_id, field_path, {boosted('value', 'confidence', 'lower(ocr_text)')} as confidence
  from {PRIMARY} p left join {TEXTS} t on t.document_id = p.document_id""")
def evidence_boost(spark, d):
    boosted_fields = R.boost_fields(view(spark, d, "fx_primary"), view(spark, d, "fx_po_text"))
    return boosted_fields.select("document_id", "field_path", "confidence")


def pattern_provider() -> Callable[[str], tuple[str, int | None, int | None]]:
    """A deterministic provider for tests: ``Label value`` lines of the text become fields."""
    import json
    import re

    labels = {"order": "po_number", "date": "po_date", "due": "due_date", "terms": "payment_terms",
              "from": "vendor.name", "buyer": "buyer.name"}
    line = re.compile(r"^(\w+) (.+)$", re.MULTILINE)

    def call(prompt: str):
        body = prompt.split("\n---\n", 1)[1]
        found = {labels[k.lower()]: {"value": v.strip(), "confidence": 0.9}
                 for k, v in line.findall(body) if k.lower() in labels}
        reply = json.dumps(found)
        return reply, len(prompt.split()), len(reply.split())

    return call


@query(f"""select document_id,
  nullif(regexp_extract(ocr_text, 'Order (.+)', 1), '') as po_number, nullif(regexp_extract(ocr_text, 'Date (.+)', 1), '') as po_date,
  nullif(regexp_extract(ocr_text, 'From (.+)', 1), '') as vendor_name, nullif(regexp_extract(ocr_text, 'Buyer (.+)', 1), '') as buyer_name
  from {TEXTS} t""")
def provider_pass(spark, d):
    """Prompt, call the deterministic test provider, read its reply back."""
    prompts = R.prompt_table(view(spark, d, "fx_po_text"))
    replies = R.clean_replies(R.apply_provider(prompts, pattern_provider, "local"))
    value = lambda p: F.try_variant_get(F.try_element_at("m", F.lit(p)), "$.value", "string")
    return replies.withColumn("m", F.from_json("reply_json", R.MAP)).select(
        "document_id", value("po_number").alias("po_number"), value("po_date").alias("po_date"),
        value("vendor.name").alias("vendor_name"), value("buyer.name").alias("buyer_name"))


# --- two passes -------------------------------------------------------------------------------

def _flagged(fields):
    low = F.col("confidence") < 0.75
    return fields.withColumns({"flagged": low, "review_reason": F.when(low, F.lit("low_confidence"))})


def first_pass(spark, d, known=None, name="fx_primary"):
    """A pass, made from headers that were dealt out: the eleven rows of a document need not cross the network."""
    headers = (known or prepared(spark, d, "fx_po"))["fx_po"]
    return view(spark, d, name, {"fx_po": spread(headers, "document_id")})


def both_passes(spark, d, known=None):
    known = known or prepared(spark, d, "fx_po")
    return tuple(_flagged(first_pass(spark, d, known, n)).drop("k") for n in ("fx_primary", "fx_fallback"))


@query(f"""select document_id, array_to_string(list_sort(list(field_path)), ',') as field_paths
  from {PRIMARY} p where confidence < 0.75 group by document_id""")
def escalation_set(spark, d):
    return P.escalation_set(view(spark, d, "fx_primary")).withColumn("field_paths", F.array_join("field_paths", ","))


def key_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[,.]', '', 'g'), '\\s+', ' ', 'g'))"


DISAGREES = f"""(p.value is not null and f.value is not null and {key_sql('p.value')} <> {key_sql('f.value')}
  and abs(p.confidence - f.confidence) > 0.15::double)"""


@query(f"""select document_id, field_path, p.value primary_value, f.value fallback_value, p.confidence primary_confidence,
  f.confidence fallback_confidence from {PRIMARY} p join {FALLBACK} f using (document_id, field_path) where {DISAGREES}""")
def disagreement(spark, d):
    known = prepared(spark, d, "fx_po")
    return written_in_place(P.disagreement(first_pass(spark, d, known), first_pass(spark, d, known, "fx_fallback")), "differing")


MERGED = f"""(select document_id, field_path,
  case when f.confidence is not null then f.value else p.value end as value,
  coalesce(f.confidence, p.confidence) as confidence, coalesce(f.source_model, p.source_model) as source_model,
  coalesce({DISAGREES}, false) or coalesce(f.confidence, p.confidence) < 0.75 as flagged,
  case when {DISAGREES} then 'model_disagreement' when coalesce(f.confidence, p.confidence) < 0.75 then 'low_confidence' end as review_reason,
  coalesce({DISAGREES}, false) as disagrees
  from {PRIMARY} p full join {FALLBACK} f using (document_id, field_path))"""


def merged(spark, d, known=None):
    """The merged rows as a table, which most queries read several times; the rows of a document lie together."""
    return written_in_place(P.merge_passes(*both_passes(spark, d, known)), "merged")


@query(f"select * from {MERGED} m")
def merge_passes(spark, d):
    return merged(spark, d).drop("value_type", "raw_text")


@query(f"""select document_id, field_path, value, confidence, confidence < 0.75 and o_orderstatus = 'F' as flagged,
  case when confidence < 0.75 and o_orderstatus = 'F' then 'low_confidence' end as review_reason
  from {PRIMARY} p join orders on o_orderkey = document_id""")
def flag_unescalated(spark, d):
    """The second pass could not run for the orders of one status."""
    orders = table(spark, d, "orders")
    failed = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"))
    out = P.flag_unescalated(first_pass(spark, d), failed)
    return out.select("document_id", "field_path", "value", "confidence", "flagged", "review_reason")


@query(f"""select document_id, cast(sum(coalesce(prompt_tokens, 0)) as bigint) prompt_tokens,
  cast(sum(coalesce(completion_tokens, 0)) as bigint) completion_tokens, cast(sum(latency_ms) as bigint) latency_ms,
  (select string_agg(pass, '+' order by first) from (select pass, min(seq) as first from {CALLS} o where o.document_id = c.document_id group by pass)) passes,
  coalesce(string_agg(parse_error, '; ' order by seq), '') parse_errors
  from {CALLS} c group by document_id""")
def pass_costs(spark, d):
    return P.pass_costs(view(spark, d, "fx_calls"))


_ASKED = f"(select document_id, ts, unnest(['local', 'groq']) as provider from {REQUESTS} r)"
_HEALTH = f"""(select a.document_id, a.provider, case when a.ts - h.ts < interval 30 second then h.ok end as ok,
  case when a.ts - h.ts < interval 30 second then (epoch_us(a.ts) - epoch_us(h.ts)) / 1000::double end as age_ms
  from {_ASKED} a asof left join {HEALTH} h on a.provider = h.provider and a.ts >= h.ts)"""


def _asked(spark, d):
    both = F.explode(F.array(F.lit("local"), F.lit("groq")))
    return view(spark, d, "fx_requests").withColumn("provider", both)


@query(f"select * from {_HEALTH} h")
def health_asof(spark, d):
    return P.health_asof(_asked(spark, d), view(spark, d, "fx_health"))


# probes of the test data are minutes apart, so routing is shown with a wider time to live
_WIDE = f"""(select a.document_id, a.provider, case when a.ts - h.ts < interval 900 second then h.ok end as ok
  from {_ASKED} a asof left join {HEALTH} h on a.provider = h.provider and a.ts >= h.ts)"""


@query(f"""select document_id, quality, local_ok, remote_ok,
  case when not local_ok and not remote_ok then null when not local_ok or quality < 0.3 then 'groq' else 'local' end as "primary",
  case when not local_ok and not remote_ok then 'no provider available' end as route_error
  from (select h.document_id, any_value(e.value / 100::double) quality,
    coalesce(bool_or(ok) filter (provider = 'local'), false) local_ok, coalesce(bool_or(ok) filter (provider = 'groq'), false) remote_ok
    from {_WIDE} h join events e on e.event_id = h.document_id group by h.document_id) x""")
def route_primary(spark, d):
    health = P.health_asof(_asked(spark, d), view(spark, d, "fx_health"), ttl_seconds=900)
    up = lambda p: F.coalesce(F.bool_or(F.when(F.col("provider") == p, F.col("ok"))), F.lit(False))
    state = health.groupBy("document_id").agg(up("local").alias("local_ok"), up("groq").alias("remote_ok"))
    quality = table(spark, d, "events").select(
        F.col("event_id").alias("document_id"), (F.col("value") / F.lit(100).cast("double")).alias("quality"))
    return P.choose_primary(state.join(quality, "document_id"))
