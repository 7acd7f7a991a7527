"""Analyses over runs, flags and exports, in batch and stream form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.operators import analysis as Y
from ledgerlens.plans.record_queries import BODIES, JOBS, LINE_ITEMS_SQL, flags, line_items_parse, po_items, records
from ledgerlens.plans.registry import query
from ledgerlens.plans.rule_queries import ALL_FLAGS_SQL, ITEMS, PO
from ledgerlens.session import work_dir
from ledgerlens.sinks import exports as E
from ledgerlens.sources import folders as FO
from ledgerlens.sources.views import duck, table, view
from ledgerlens.streaming import streams as ST

HEALTH = duck("fx_health")


def probes(spark, d):
    return view(spark, d, "fx_health").withColumn("ts", F.col("ts").cast("timestamp"))


def delivered(spark, rows, name: str, parts: int = 3):
    """Rows as a stream of files in order of time, and a last row long after that lets every window end."""
    base = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return None, base
    step = (high - low) / parts
    for i in range(parts):
        upper = F.col("ts") < F.lit(low + step * (i + 1)) if i < parts - 1 else F.lit(True)
        rows.filter((F.col("ts") >= F.lit(low + step * i)) & upper).write.mode("append").parquet(f"{base}/in/part={i}")
    end = rows.limit(1).withColumn("ts", (F.lit(high) + F.expr("interval 60 days")).cast(rows.schema["ts"].dataType))
    end.write.mode("append").parquet(f"{base}/in/part={parts}")
    return [f"{base}/in/part={i}" for i in range(parts + 1)], base


def run_parts(spark, rows, name: str, operator, late: str = "1 hour"):
    """Each part is one run of the same checkpoint."""
    folders, base = delivered(spark, rows, name)
    if folders is None:
        return operator(rows)
    pattern, made = f"{base}/feed", None
    for folder in folders:
        spark.read.parquet(folder).write.mode("append").parquet(pattern)
        stream = spark.readStream.schema(rows.schema).parquet(pattern).withWatermark("ts", late)
        made, _ = ST.run_available(operator(stream), name, folder=f"{base}/out")
    return ST.read_back(spark, made)


# --- windows of activity ------------------------------------------------------------------------------

_PHASES = f"""select provider, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_probes, count(*) filter (not ok) as n_failed
  from (select *, sum(begins) over (partition by provider order by ts, seq) as phase
        from (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by provider order by ts, seq)) < 600000000 then 0 else 1 end as begins from {HEALTH} h) b) p
  group by provider, phase"""
_SLIDES = f"""select provider, make_timestamp(w) as from_ts, count(*) as n_probes, count(*) filter (not ok) as n_failed
  from (select *, unnest([epoch_us(ts) // 300000000 * 300000000 - k * 300000000 for k in range(0, 3)]) as w from {HEALTH} h) s group by provider, w"""


@query(_PHASES)
def busy_phases(spark, d):
    return Y.busy_phases(probes(spark, d))


@query(_PHASES)
def stream_busy_phases(spark, d):
    return run_parts(spark, probes(spark, d), "phases", Y.busy_phases)


@query(_SLIDES)
def sliding_failures(spark, d):
    return Y.sliding_failures(probes(spark, d))


@query(_SLIDES)
def stream_sliding_failures(spark, d):
    return run_parts(spark, probes(spark, d), "slides", Y.sliding_failures)


@query(f"""select job_id, seq, status, null as error_message from {JOBS} j
  union all select job_id, seq, 'failed', 'Timed out after 600s.' from (
    select *, lead(ts) over (partition by job_id order by ts, seq) next_ts from {JOBS} j) x
  where status = 'processing' and (next_ts is null or epoch_ms(next_ts) - epoch_ms(ts) > 600000)""")
def stream_event_tracker(spark, d):
    """State changes and timeouts on the events' own clock; the row that ends the stream belongs to no job."""
    jobs = view(spark, d, "fx_jobs")
    folders, base = delivered(spark, jobs, "tracked")
    if folders is None:
        return jobs.select("job_id", "seq", "status", F.lit(None).cast("string").alias("error_message"))
    table = None
    for i, folder in enumerate(folders):
        part = spark.read.parquet(folder)
        part = part.withColumn("job_id", F.lit(None).cast("long")) if i == len(folders) - 1 else part
        part.write.mode("append").parquet(f"{base}/feed")
        table, _ = ST.run_available(ST.track_jobs_in_event_time(spark.readStream.schema(jobs.schema).parquet(f"{base}/feed")), "t", folder=f"{base}/out")
    return ST.read_back(spark, table)


# --- sketches -------------------------------------------------------------------------------------------

def run_calls(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("provider"), F.col("ts").cast("date").alias("day"), (F.col("value") * 10).alias("latency_ms"), "user_id")


_CALLS = "(select event_type as provider, cast(ts as date) as day, value * 10 as latency_ms, user_id from events)"


@query(f"""select provider, count(latency_ms) as n, count(distinct user_id) as n_users, round(quantile_cont(latency_ms, 0.5), 6) as p50,
  round(quantile_cont(latency_ms, 0.9), 6) as p90, round(quantile_cont(latency_ms, 0.99), 6) as p99 from {_CALLS} c group by provider""")
def latency_quantiles(spark, d):
    """Exact, from all rows; what the sketches are held against."""
    at = lambda r: F.round(F.percentile("latency_ms", r), 6)
    return run_calls(spark, d).groupBy("provider").agg(
        F.count("latency_ms").alias("n"), F.count_distinct("user_id").alias("n_users"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


@query(f"""select provider, cast(r as double) as rank, n, true as quantile_holds, true as distinct_holds
  from (select provider, count(latency_ms) as n from {_CALLS} c group by provider) g, (values (0.5), (0.9), (0.99)) t(r)""")
def latency_sketches(spark, d):
    """Merged daily sketches: whether each quantile is within 1 % of its rank and the distinct count within 3 % of the exact one."""
    calls = run_calls(spark, d)
    ranks = (0.5, 0.9, 0.99)
    merged = Y.merged_sketches(Y.daily_sketches(calls, ["provider"], "latency_ms", "user_id"), ["provider"], ranks)
    marks = merged.select("provider", "n", "n_distinct", F.posexplode("estimates").alias("i", "estimate")).withColumn(
        "rank", F.get(F.array(*[F.lit(r) for r in ranks]), F.col("i")))
    off = Y.ranks_of(calls, ["provider"], "latency_ms", marks)
    exact = calls.groupBy("provider").agg(F.count_distinct("user_id").alias("exact"))
    shown = marks.join(off.drop("estimate"), ["provider", "rank"]).join(exact, "provider")
    holds = (F.col("share_below") <= F.col("rank") + 0.01) & (F.col("share_up_to") >= F.col("rank") - 0.01)
    return shown.select("provider", "rank", "n", holds.alias("quantile_holds"), (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.03 * F.col("exact") + 0.5).alias("distinct_holds"))


# --- totals -------------------------------------------------------------------------------------------------

@query(f"""select rule_name, severity, vendor_country, cast(grouping_id(rule_name, severity, vendor_country) as int) as level, count(*) as n_flags,
  count(distinct document_id) as n_documents
  from (select f.document_id, split_part("rule", ':', 1) as rule_name, severity, vendor_country from ({ALL_FLAGS_SQL}) f left join {PO} p using (document_id)) x
  group by cube (rule_name, severity, vendor_country)""")
def flag_totals(spark, d):
    """Flags by rule, severity and the vendor's country, with all totals."""
    countries = view(spark, d, "fx_po").select("document_id", "vendor_country")
    named = flags(spark, d).select("document_id", F.split_part("rule", F.lit(":"), F.lit(1)).alias("rule_name"), "severity")
    return Y.flag_cube(named.join(countries, "document_id", "left"), ["rule_name", "severity", "vendor_country"])


# --- differences ------------------------------------------------------------------------------------------------

#: two exports of item rows without their positions, so rows repeat; the second lacks some, has some twice and some changed
_OLD = "select document_id, part_number, currency from {items}"
_NEW = """select document_id, part_number, case when suppkey % 5 = 0 then 'GBP' else currency end as currency from {items} where suppkey % 7 <> 0
  union all select document_id, part_number, currency from {items} where suppkey % 4 = 0"""


def _exports(spark, d):
    items = view(spark, d, "fx_items")
    return [spark.sql(text, items=items) for text in (_OLD, _NEW)]


_OLD_SQL, _NEW_SQL = (f"({t.replace('{items}', ITEMS + ' i')})" for t in (_OLD, _NEW))
_GONE = f"(select *, count(*) as n from (select * from {_OLD_SQL} o except all select * from {_NEW_SQL} n) g group by all)"
_CAME = f"(select *, count(*) as n from (select * from {_NEW_SQL} n except all select * from {_OLD_SQL} o) g group by all)"


@query(f"""with gone as {_GONE}, came as {_CAME}
  select g.document_id, g.part_number, g.currency, case when exists (select 1 from came c where c.document_id = g.document_id and c.part_number = g.part_number)
    then 'changed' else 'removed' end as change, n as n_removed, 0 as n_added from gone g
  union all select c.document_id, c.part_number, c.currency, case when exists (select 1 from gone g where c.document_id = g.document_id and c.part_number = g.part_number)
    then 'changed' else 'added' end, 0, n from came c""")
def export_changes(spark, d):
    """What changed between two exports, repeated rows counted."""
    old, new = _exports(spark, d)
    return Y.bag_changes(old, new, ["document_id", "part_number"])


@query(f"select * , count(*) as n from (select * from {_OLD_SQL} o intersect all select * from {_NEW_SQL} n) b group by all")
def export_unchanged(spark, d):
    both = Y.unchanged(*_exports(spark, d))
    return both.groupBy(*both.columns).agg(F.count(F.lit(1)).alias("n"))


# --- quality counters ----------------------------------------------------------------------------------------------

@query(f"""select count(*) as "rows", count(reject_reason) as rejected, count(*) filter (reject_reason = 'missing description') as without_description,
  count(*) filter (reject_reason like '%negative') as negative_numbers, count(*) filter (quantity is null) as without_quantity from ({LINE_ITEMS_SQL}) p""")
def item_counters(spark, d):
    """Counters of the item parser, filled while its rows are written."""
    reason = F.col("reject_reason")
    rows, seen = Y.counted(line_items_parse(spark, d), "items", rejected=reason.isNotNull(), without_description=reason == "missing description",
                           negative_numbers=reason.endswith("negative"), without_quantity=F.col("quantity").isNull())
    rows.write.parquet(f"{work_dir(spark)}/items-{uuid.uuid4().hex}")
    found = seen.get
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"`{n}` long" for n in found))


# --- states of a past moment -------------------------------------------------------------------------------------------

#: a user's events as the history of a document: corrections, decisions, and the moments of its exports
_HISTORY = "select user_id as document_id, ts, event_id as seq, event_type, value from events"
_AT = """(select h.document_id, h.seq, (select arg_max(x.value, struct_pack(a := x.ts, b := x.seq)) from hist x
    where x.document_id = h.document_id and x.event_type = 'view' and x.ts <= h.ts) as corrected_value,
  (select arg_max(x.event_type, struct_pack(a := x.ts, b := x.seq)) from hist x
    where x.document_id = h.document_id and x.event_type in ('purchase', 'error') and x.ts <= h.ts) as decision from hist h where h.event_type = 'click')"""


@query(f"""with hist as ({_HISTORY}) select document_id, seq, corrected_value, case decision when 'purchase' then 'approved' when 'error' then 'rejected' else 'pending' end as status from {_AT} a""")
def result_asof(spark, d):
    """Each export with the correction and the decision that held at its moment."""
    history = table(spark, d, "events").select(
        F.col("user_id").alias("document_id"), F.col("ts"), F.col("event_id").alias("seq"), "event_type", "value")
    key = ["document_id"]
    exports = history.filter("event_type = 'click'").select("document_id", "ts", "seq")
    fixed = Y.validity(history.filter("event_type = 'view'").select("document_id", "ts", "seq", F.col("value").alias("corrected_value")), key)
    decided = Y.validity(history.filter("event_type in ('purchase', 'error')").select(
        "document_id", "ts", "seq", F.when(F.col("event_type") == "purchase", "approved").otherwise("rejected").alias("status")), key)
    seen = Y.as_of(exports, fixed, key).drop("valid_from", "valid_to")
    seen = Y.as_of(seen, decided, key)
    return seen.select("document_id", "seq", "corrected_value", F.coalesce("status", F.lit("pending")).alias("status"))


# --- folders -------------------------------------------------------------------------------------------------------------

def _mail_folder(spark, d) -> str:
    """Every conversation as a message file: one turn a part."""
    turns = table(spark, d, "conversations").filter("conv_id is not null").select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    part = F.concat(F.lit("--cut\r\nContent-Type: application/pdf\r\nContent-Transfer-Encoding: base64\r\nContent-Disposition: attachment; filename=\"part"),
                    F.col("turn").cast("string"), F.lit(".pdf\"\r\n\r\n"), F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "")
    mails = turns.groupBy("conv_id").agg(F.min("role").alias("role"), listed.alias("parts"))
    head = F.concat(F.lit("From: "), "role", F.lit("@example.com\r\nSubject: Order "), F.col("conv_id").cast("string"),
                    F.lit("\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=cut\r\n\r\n"))
    named = mails.select(F.concat(F.pmod("conv_id", F.lit(10)).cast("string"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".eml")).alias("name"),
                         F.concat(head, "parts", F.lit("--cut--\r\n")).alias("body"))
    folder = f"{work_dir(spark)}/mail-{uuid.uuid4().hex}"
    FO.register(spark)
    named.write.format("named_files").mode("append").save(folder)
    return folder


_PARTS = """(select conv_id, cast(row_number() over (partition by conv_id order by turn, role, text) - 1 as int) as part_no, min(role) over (partition by conv_id) || '@example.com' as sender,
  'Order ' || conv_id as subject, 'attachment' as disposition, 'part' || turn || '.pdf' as filename, 'application/pdf' as mime_type,
  octet_length(encode(coalesce(text, ''))) as size_bytes from conversations where conv_id is not null)"""


def _shown(parts):
    conv = F.regexp_extract("name", r"(\d+)\.eml$", 1).cast("long").alias("conv_id")
    return parts.select(conv, "part_no", "sender", "subject", "disposition", "filename", "mime_type", "size_bytes")


@query(f"select * from {_PARTS} p")
def message_folder(spark, d):
    """Parts of all messages of a folder."""
    return _shown(spark.read.format("message_folder").load(_mail_folder(spark, d)))


@query(f"select * from {_PARTS} p where conv_id % 10 = 3")
def message_folder_prefix(spark, d):
    """Only the files of one subfolder are opened."""
    return _shown(spark.read.format("message_folder").load(_mail_folder(spark, d)).filter(F.col("name").startswith("3/")))


@query(f"select * from {_PARTS} p")
def stream_message_folder(spark, d):
    """The same folder as a stream, read in two runs of one checkpoint."""
    folder, out = _mail_folder(spark, d), f"{work_dir(spark)}/mail-out-{uuid.uuid4().hex}"
    for _ in range(2):
        stream = _shown(spark.readStream.format("message_folder").load(folder))
        made, _ = ST.run_available(stream, "mail", folder=out)
    return ST.read_back(spark, made)


@query(f"""select 'po_' || coalesce(nullif(po_number, ''), substring(cast(document_id as varchar), 1, 8)) || '.json' as file, document_id, body
  from {BODIES} b join (select document_id, po_number from {PO} p) p using (document_id)
  where document_id in (select document_id from {duck('fx_approvals')} a where status = 'approved')""")
def export_files(spark, d):
    """Approved records as one file each, below a folder for each result, read back."""
    po = records(spark, d)
    approved = view(spark, d, "fx_approvals").filter("status = 'approved'").select("document_id")
    bodies = E.export_json(po, po_items(spark, d)).join(po.select("document_id", "po_number"), "document_id").join(approved, "document_id", "left_semi")
    named = bodies.select(F.concat(F.col("document_id").cast("string"), F.lit("/"), E.export_name(F.col("po_number"), F.col("document_id"), "json")).alias("name"), "body")
    folder = f"{work_dir(spark)}/export-{uuid.uuid4().hex}"
    FO.register(spark)
    named.write.format("named_files").mode("append").save(folder)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    place = F.regexp_extract("path", r"([^/]+)/([^/]+)$", 1).cast("long").alias("document_id")
    return back.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), place, F.decode("content", "UTF-8").alias("body"))
