"""Job tracking over a table of lifecycle events (J15, L1, W5, T4 batch form, P16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlens.constants import DASHBOARD_JOBS, TASK_TIMEOUT_SECONDS, TERMINAL_STATUSES


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL_STATUSES)


def current_jobs(events: DataFrame) -> DataFrame:
    """State of each job: last status, first and last event time (T2 in batch form).

    Only aggregates that combine map-side, so a job with very many events is one row
    per task after the scan.
    """
    order = F.struct("ts", "seq")
    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.max(F.when(F.col("status") == "complete", F.col("ts"))).alias("completed_at"),
        F.count(F.lit(1)).alias("n_events"))


def partial_jobs(events: DataFrame) -> DataFrame:
    """One row per job of a part of the events, to be merged with other parts."""
    last = F.max(F.struct("ts", "seq", "status")).alias("last")
    return events.groupBy("job_id").agg(
        last, F.min("ts").alias("created_at"), F.max(F.when(F.col("status") == "complete", F.col("ts"))).alias("completed_at"),
        F.count(F.lit(1)).alias("n_events"))


def merge_jobs(parts: DataFrame) -> DataFrame:
    """State of each job from parts in any order; equals :func:`current_jobs` over all events."""
    return parts.groupBy("job_id").agg(
        F.max("last").alias("last"), F.min("created_at").alias("created_at"), F.max("completed_at").alias("completed_at"),
        F.sum("n_events").alias("n_events"),
    ).select("job_id", F.col("last.status").alias("status"), "created_at", F.col("last.ts").alias("updated_at"), "completed_at", "n_events")


def jobs_dashboard(jobs: DataFrame, results: DataFrame, n: int = DASHBOARD_JOBS) -> DataFrame:
    """The newest ``n`` jobs with their current results.

    The top-n runs before the join, so at most ``n`` rows look for a result. A job
    without a source came in by mail; ``source_email`` is ``upload`` for uploads.
    """
    newest = jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(n)
    out = newest.join(results, "job_id", "left")
    if "source_email" in out.columns:
        uploaded = F.col("source_email") == "upload"
        out = out.withColumns({
            "source": F.when(uploaded, F.lit("upload")).otherwise(F.lit("email")),
            "source_email": F.when(~uploaded, F.col("source_email"))})
    if "filename" in out.columns:
        out = out.withColumn("filename", F.coalesce("filename", F.lit("document")))
    return out


def job_transitions(events: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Each event with the one before and the one after it in the same job.

    A window over the whole job would sort a hot job in one task. Events are
    numbered inside (job, time bucket) instead; the first and last event of each
    bucket, one row per bucket, carry the neighbours across bucket borders.
    """
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (bucket_seconds * 1_000_000))
    keyed = events.withColumn("_b", bucket)
    order = F.struct("ts", "seq")
    event = F.struct("status", "ts")
    inside = W.partitionBy("job_id", "_b").orderBy("ts", "seq")
    near = keyed.withColumns({"_prev": F.lag(event).over(inside), "_next": F.lead(event).over(inside)})
    edges = keyed.groupBy("job_id", "_b").agg(F.min_by(event, order).alias("_first"), F.max_by(event, order).alias("_last"))
    across = W.partitionBy("job_id").orderBy("_b")
    edges = edges.select("job_id", "_b", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    joined = near.join(edges, ["job_id", "_b"])
    before, after = F.coalesce("_prev", "_before"), F.coalesce("_next", "_after")
    return joined.select(
        "job_id", "seq", "ts", "status", before["status"].alias("previous_status"), after["status"].alias("next_status"),
        after["ts"].alias("next_ts"))


def job_timeouts(events: DataFrame, as_of, timeout_seconds: int = TASK_TIMEOUT_SECONDS) -> DataFrame:
    """Processing phases that lasted longer than the limit (T4 in batch form).

    A phase without a following event is measured to ``as_of``.
    """
    end = F.coalesce("next_ts", F.lit(as_of).cast("timestamp_ntz"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    lasted = (micros(end) - micros(F.col("ts"))) / F.lit(1_000_000).cast("double")
    return (
        job_transitions(events).filter(F.col("status") == "processing").withColumn("lasted_seconds", lasted)
        .filter(F.col("lasted_seconds") > timeout_seconds)
        .select("job_id", "seq", "lasted_seconds", F.lit("failed").alias("status"),
                F.lit(f"Timed out after {timeout_seconds}s.").alias("error_message"))
    )
