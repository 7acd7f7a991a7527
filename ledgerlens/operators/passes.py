"""Two extraction passes: choose, escalate, compare, merge, price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlens.constants import (
    ALWAYS_ESCALATE, CONFIDENCE_THRESHOLD, DISAGREEMENT_THRESHOLD, HEALTH_TTL_SECONDS, LOCAL_QUALITY_MINIMUM,
)
from ledgerlens.functions import numbers as N, text as T
from ledgerlens.operators.frames import with_columns_present

FIELD_TYPES = {"value_type": "string", "flagged": "boolean", "review_reason": "string", "raw_text": "string"}
KEYS = ["document_id", "field_path"]


def choose_primary(
    documents: DataFrame, local: str = "local", remote: str = "groq", minimum: float = LOCAL_QUALITY_MINIMUM,
) -> DataFrame:
    """First provider per document (P11) from ``quality, local_ok, remote_ok``.

    ``primary`` is null with a ``route_error`` when no provider is up.
    """
    local_ok, remote_ok = (F.coalesce(c, F.lit(False)) for c in ("local_ok", "remote_ok"))
    primary = F.when(~local_ok & ~remote_ok, F.lit(None).cast("string")).when(
        ~local_ok | (F.col("quality") < minimum), F.lit(remote)).otherwise(F.lit(local))
    return documents.withColumns({
        "primary": primary,
        "route_error": F.when(~local_ok & ~remote_ok, F.lit("no provider available")),
    })


def needs_escalation(threshold: float = CONFIDENCE_THRESHOLD, always: Sequence[str] = ALWAYS_ESCALATE) -> Column:
    return (F.col("confidence") < threshold) | F.col("field_path").isin(*always)


def escalation_set(fields: DataFrame, threshold: float = CONFIDENCE_THRESHOLD,
                   always: Sequence[str] = ALWAYS_ESCALATE) -> DataFrame:
    """Sorted field paths per document to ask for again (U1). Bounded by the catalog."""
    return (
        fields.filter(needs_escalation(threshold, always))
        .groupBy("document_id").agg(F.array_sort(F.collect_set("field_path")).alias("field_paths"))
    )


def _differs(a: Column, b: Column, strict: bool) -> Column:
    same = T.value_key(a) == T.value_key(b)
    if strict:
        x, y = N.to_number(a), N.to_number(b)
        same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(same)
    return ~same


def _disagrees(p: str, f: str, gap: float, strict: bool) -> Column:
    """Both values present, unequal after normalising, and confidences further apart than ``gap``.

    ``strict`` drops the confidence condition and compares numbers as numbers.
    """
    both = F.col(f"{p}.value").isNotNull() & F.col(f"{f}.value").isNotNull()
    apart = F.lit(True) if strict else F.abs(F.col(f"{p}.confidence") - F.col(f"{f}.confidence")) > gap
    return both & apart & _differs(F.col(f"{p}.value"), F.col(f"{f}.value"), strict)


def disagreement(primary: DataFrame, fallback: DataFrame, gap: float = DISAGREEMENT_THRESHOLD,
                 strict: bool = False) -> DataFrame:
    """Fields on which the two passes disagree (J2): equi-join on document and field."""
    joined = primary.alias("p").join(fallback.alias("f"), KEYS).filter(_disagrees("p", "f", gap, strict))
    return joined.select(
        *KEYS, F.col("p.value").alias("primary_value"), F.col("f.value").alias("fallback_value"),
        F.col("p.confidence").alias("primary_confidence"), F.col("f.confidence").alias("fallback_confidence"),
    )


def merge_passes(primary: DataFrame, fallback: DataFrame, gap: float = DISAGREEMENT_THRESHOLD,
                 strict: bool = False) -> DataFrame:
    """One field table from two (J3): the second pass wins where it has a row.

    The disagreement test runs on the joined row, so comparing and merging share
    one join. Each side brings one row per (document, field).
    """
    primary, fallback = (with_columns_present(d, FIELD_TYPES) for d in (primary, fallback))
    kept = [c for c in primary.columns if c in fallback.columns and c not in KEYS]
    joined = primary.alias("p").join(fallback.alias("f"), KEYS, "full")
    second = F.col("f.confidence").isNotNull()
    clash = F.coalesce(_disagrees("p", "f", gap, strict), F.lit(False))
    out = {c: F.when(second, F.col(f"f.{c}")).otherwise(F.col(f"p.{c}")) for c in kept}
    out["flagged"] = clash | F.coalesce(out["flagged"], F.lit(False))
    out["review_reason"] = F.when(clash, F.lit("model_disagreement")).otherwise(out["review_reason"])
    return joined.select(*KEYS, *[c.alias(n) for n, c in out.items()], clash.alias("disagrees"))


def flag_unescalated(fields: DataFrame, failed: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Escalation could not run for the documents in ``failed(document_id)`` (J4):
    their escalation set is flagged instead, everything else is unchanged."""
    fields = with_columns_present(fields, FIELD_TYPES)
    marked = fields.join(failed.select("document_id").distinct().withColumn("_failed", F.lit(True)), "document_id", "left")
    hit = F.coalesce(F.col("_failed"), F.lit(False)) & needs_escalation(threshold)
    return marked.withColumns({
        "flagged": hit | F.coalesce("flagged", F.lit(False)),
        "review_reason": F.when(hit, F.lit("low_confidence")).otherwise(F.col("review_reason")),
    }).drop("_failed")


def pass_costs(calls: DataFrame) -> DataFrame:
    """Tokens and latency summed over the passes of a document.

    Passes are named once each in the order they first ran, and every parse error is
    kept, repeated ones too, in the order of the calls (``seq``). The lists are
    as long as a document's calls, of which the pipeline makes two or a few.
    """
    def in_order(name: str) -> Column:
        called = F.collect_list(F.when(F.col(name).isNotNull(), F.struct("seq", F.col(name).alias("x"))))
        return F.transform(F.array_sort(called), lambda c: c["x"])

    return calls.groupBy("document_id").agg(
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"),
        F.sum("latency_ms").alias("latency_ms"),
        F.array_join(F.array_distinct(in_order("pass")), "+").alias("passes"),
        F.array_join(in_order("parse_error"), "; ").alias("parse_errors"),
    )


def health_asof(requests: DataFrame, probes: DataFrame, ttl_seconds: int = HEALTH_TTL_SECONDS) -> DataFrame:
    """Latest probe of each provider at the moment of a request, if fresh enough.

    ``requests(document_id, provider, ts)``, ``probes(provider, ts, ok, seq)``. There
    are very few providers, so nothing may be partitioned by provider alone. A probe
    counts for less than ``ttl``, so time is cut into ttl-wide buckets and a request
    only looks at its own bucket and the one before. Probes and requests of one
    instant collapse to one row each before the window.
    """
    micros = ttl_seconds * 1_000_000
    key = ["provider", "bucket"]

    def stamped(df: DataFrame) -> DataFrame:
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        return df.withColumns({"at": at, "bucket": F.floor(at / micros)})

    instants = stamped(probes).groupBy(*key, "at").agg(F.max_by("ok", "seq").alias("ok"))
    last = instants.groupBy(*key).agg(F.max(F.struct("at", "ok")).alias("carry"))
    carried = last.select("provider", (F.col("bucket") + 1).alias("bucket"), "carry")
    asked = stamped(requests)
    moments = asked.select(*key, "at").distinct()
    both = instants.select(*key, "at", F.struct("at", "ok").alias("probe")).unionByName(
        moments.withColumn("probe", F.lit(None).cast("struct<at:bigint,ok:boolean>")))
    # a probe at the very moment of the request counts: RANGE includes peers
    upto = W.partitionBy(*key).orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    seen = both.withColumn("seen", F.last("probe", ignorenulls=True).over(upto)).filter(F.col("probe").isNull())
    answered = seen.join(carried, key, "left").select(*key, "at", F.coalesce("seen", "carry").alias("hit"))
    answered = answered.filter(F.col("at") - F.col("hit.at") < micros)
    return asked.join(answered, [*key, "at"], "left").select(
        "document_id", "provider", F.col("hit.ok").alias("ok"),
        ((F.col("at") - F.col("hit.at")) / F.lit(1000).cast("double")).alias("age_ms"),
    )
