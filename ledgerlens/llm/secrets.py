"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a path is addressed by the digest of its content. A ledger row says that a
blob was scanned under one rule and rule version, and holds what was found (an empty list for
a clean blob). A run scans only the (blob, rule, version) triples that the ledger lacks, so
copies, renames and reverts cost nothing and a changed rule is the only one scanned again.
Findings are joined back to every path that holds the blob.

Positions: ``split`` gives the text between matches and ``regexp_extract_all`` the matches
themselves, in order; their running lengths are the spans, counted in code points.

Null texts count as empty. Very long texts are scanned whole. A null path or version is a
path of its own; rows repeated whole share one blob and give a row each; empty tables give
empty results; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledgerlens.llm.common import stored, table
from ledgerlens.plans.registry import Query


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    ``hint`` must match in every text that holds a finding; it only saves the full scan.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1


# The base rules of the scan, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         r"(?i:password|passwd|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    # runs shorter than the least length can be left out of the pattern: a run matches whole
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
#: Further rules: private key blocks and signed web tokens.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 0, 40, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
)
RULES = BASE + ADDED

FINDING = "struct<start: int, end: int>"
LEDGER = f"blob_id string, kind string, version int, findings array<{FINDING}>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, rule: Rule, wanted: Column) -> Column:
    """The pieces of one rule: texts between matches, matches, and the lengths that decide."""
    # the kept text of a long document is needed only where the hint fits
    hit = wanted & text.rlike(rule.hint)
    lengths = lambda a: F.transform(a, F.length)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return F.struct(
        F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), wanted.alias("wanted"),
        F.when(hit, lengths(F.split(text, rule.pattern, -1))).alias("gaps"),
        F.when(hit, lengths(whole)).alias("sizes"),
        F.when(hit, lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else lengths(whole)).alias("decides"),
    )


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of ``blobs`` (blob_id, text, kinds: array of the rules to apply)."""
    pieces = F.array(*[_matches(F.col("text"), r, F.array_contains("kinds", r.kind)) for r in rules])
    scanned = blobs.select("blob_id", F.inline(pieces)).where("wanted")
    # one row for each match, or one for a clean blob and rule; spans are running sums inside (blob, rule).
    # blobs come hashed by their id, which serves the window and the grouping as well
    match = F.arrays_zip(F.slice("gaps", 1, F.size("sizes")).alias("gap"), F.col("sizes").alias("size"), F.col("decides").alias("decides"))
    rows = scanned.select("blob_id", "kind", "version", "least", F.posexplode_outer(match).alias("n", "m")).select(
        "blob_id", "kind", "version", "least", "n", "m.*")
    here = W.partitionBy("blob_id", "kind", "version").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(here).cast("int"))
    span = F.struct((F.col("end") - F.col("size")).cast("int").alias("start"), "end")
    return rows.groupBy("blob_id", "kind", "version").agg(
        F.sort_array(F.collect_list(F.when(F.col("decides") >= F.col("least"), span))).alias("findings"))


def unseen(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Distinct blobs of ``versions`` (blob_id, text) with the rules that the ledger lacks for them.

    Copies are folded before the shuffle, so a blob with many paths moves once for each task.
    """
    blobs = versions.groupBy("blob_id").agg(F.first("text").alias("text"))
    if ledger is None:
        return blobs.withColumn("kinds", F.array(*[F.lit(r.kind) for r in rules]))
    known = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    seen = ledger.select("blob_id", F.struct("kind", "version").alias("pair")).where(F.array_contains(known, F.col("pair")))
    seen = seen.groupBy("blob_id").agg(F.collect_set("pair").alias("seen"))  # at most one entry for each rule
    left = F.filter(known, lambda p: ~F.array_contains(F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>")), p))
    out = blobs.join(seen, "blob_id", "left").withColumn("kinds", F.transform(left, lambda p: p["kind"]))
    return out.where(F.size("kinds") > 0).select("blob_id", "text", "kinds")


def scan(versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New ledger rows, and ``versions`` with ``blob_id`` and ``findings`` (kind, start, end; by start, then rule order).

    The new rows are written once to the shared folder; append them to the ledger.
    """
    addressed = versions.drop("findings").withColumn("blob_id", blob_id(F.col(text)))
    new = stored(scan_blobs(unseen(addressed.select("blob_id", F.coalesce(F.col(text), F.lit("")).alias("text")), rules, ledger), rules), "ledger")
    rows = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    order = F.array_position(F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules]), F.concat_ws(":", "kind", "version"))
    each = rows.withColumn("rank", order.cast("int")).where("rank > 0 and size(findings) > 0").select(
        "blob_id", F.explode("findings").alias("f"), "rank", "kind")
    each = each.groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("f.start", "rank", "kind", "f.end"))).alias("findings"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    out = addressed.join(each, "blob_id", "left").withColumn("findings", F.coalesce("findings", none))
    return new, out


def redact(found: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace every span of ``findings`` in ``text``; overlapping spans become one mask.

    Spans come in order of their start. A mask stands where a span begins at or after
    everything before it has ended.
    """
    ends = F.transform("findings", lambda f: f["end"])
    reached = lambda i: F.when(i > 0, F.array_max(F.slice(ends, F.lit(1), F.greatest(i, F.lit(1))))).otherwise(F.lit(0))
    piece = lambda f, i: F.when(
        f["start"] >= reached(i),
        F.concat(F.substring(F.col(text), reached(i) + 1, f["start"] - reached(i)), F.lit(mask)),
    ).otherwise(F.lit(""))
    tail = F.substring(F.col(text), F.array_max(ends) + 1, F.length(text))
    return found.withColumn(text, F.when(F.size("findings") > 0, F.concat(F.array_join(F.transform("findings", piece), ""), tail)).otherwise(F.col(text)))


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def document_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of every document; the base kinds also as counts and a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, found = scan(docs)
    base = F.filter("findings", lambda f: f["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), "blob_id",
    )


def _duck_rule(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    spans = f"list_transform(generate_series(1, len(sizes_{rule.kind})), lambda i: {{'start': list_sum(gaps_{rule.kind}[1:i]) + coalesce(list_sum(sizes_{rule.kind}[1:i-1]), 0), 'rank': {rank}, 'kind': '{rule.kind}', 'size': sizes_{rule.kind}[i], 'ok': decides_{rule.kind}[i] >= {rule.least}}})"
    cols = (f"list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) as gaps_{rule.kind}, "
            f"list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) as sizes_{rule.kind}, "
            f"list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x)) as decides_{rule.kind}")
    return cols, spans


def _oracle() -> str:
    parts = [_duck_rule(r, i + 1) for i, r in enumerate(RULES)]
    names = ", ".join(f"'{r.kind}'" for r in BASE)
    text = lambda f: f"coalesce(array_to_string(list_transform({f}, lambda x: x.kind || ':' || cast(cast(x.start as bigint) as varchar) || ':' || cast(cast(x.start + x.size as bigint) as varchar)), ','), '')"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
b as (select distinct t from d),
p as (select t, {", ".join(c for c, _ in parts)} from b),
f as (select t, list_sort(list_filter(list_concat({", ".join(s for _, s in parts)}), lambda x: x.ok)) as f from p)
select doc_id, {", ".join(f"cast(len(list_filter(f, lambda x: x.kind = '{r.kind}')) as bigint) as n_{r.kind}" for r in BASE)},
       sha256({text(f"list_filter(f, lambda x: x.kind in ({names}))")}) as base_sha256, {text("f")} as spans, sha256(t) as blob_id
from d join f using (t)
"""


QUERIES = {"op4_blob_ledger_secrets": Query(document_secrets, _oracle())}
