"""Analyses over runs, flags and exports: windows of activity, sketches, totals, differences, counters, states of a past moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

# --- windows of activity ----------------------------------------------------------------------


def busy_phases(probes: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Phases of a provider without a pause of ``gap``: first and last probe, their number and failures.

    Works on a batch and, with a watermark, on a stream. Sessions are merged within each task before the
    shuffle, so a provider with most of the probes sends few rows.
    """
    phases = probes.groupBy("provider", F.session_window(F.col("ts"), gap).alias("phase")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_probes"), F.count_if(~F.col("ok")).alias("n_failed"))
    return phases.drop("phase")


def sliding_failures(probes: DataFrame, length: str = "15 minutes", slide: str = "5 minutes") -> DataFrame:
    """Probes and failures of each provider in windows of ``length`` every ``slide``; windows without a probe have no row."""
    counted = probes.groupBy("provider", F.window(F.col("ts"), length, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n_probes"), F.count_if(~F.col("ok")).alias("n_failed"))
    return counted.select("provider", F.col("w.start").alias("from_ts"), "n_probes", "n_failed")


# --- sketches -----------------------------------------------------------------------------------

#: accuracy parameters of the quantile and distinct-count sketches
KLL_K, HLL_LG_K = 400, 14


def daily_sketches(calls: DataFrame, by: list[str], value: str, who: str) -> DataFrame:
    """One row for each group and ``day``: a quantile sketch of ``value`` and a distinct sketch of ``who``.

    A sketch has a fixed size however many rows it stands for, and sketches merge: a month is the union
    of its days, so old days are never read again.
    """
    return calls.groupBy(*by, "day").agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("quantiles"), F.hll_sketch_agg(who, HLL_LG_K).alias("distinct"),
        F.count(value).alias("n"))


def merged_sketches(days: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Quantiles at ``ranks`` and the distinct count over all days of each group, from stored daily sketches."""
    merged = days.groupBy(*by).agg(
        F.kll_merge_agg_double("quantiles", KLL_K).alias("_q"), F.hll_union_agg("distinct").alias("_d"), F.sum("n").alias("n"))
    at = F.array(*[F.lit(float(r)) for r in ranks])
    return merged.select(*by, "n", F.kll_sketch_get_quantile_double("_q", at).alias("estimates"), F.hll_sketch_estimate("_d").alias("n_distinct"))


def ranks_of(values: DataFrame, by: list[str], value: str, marks: DataFrame) -> DataFrame:
    """``marks(by..., rank, estimate)`` with the exact share of values below and up to each estimate: how far off a sketch is.

    The marks are a handful for each group; values are counted against them map-side.
    """
    listed = marks.groupBy(*by).agg(F.collect_list(F.struct("rank", "estimate")).alias("_marks"))
    beside = values.filter(F.col(value).isNotNull()).join(listed, by).select(*by, F.col(value).alias("_value"), F.explode("_marks").alias("m"))
    return beside.groupBy(*by, F.col("m.rank").alias("rank"), F.col("m.estimate").alias("estimate")).agg(
        F.avg((F.col("_value") < F.col("m.estimate")).cast("double")).alias("share_below"), F.avg((F.col("_value") <= F.col("m.estimate")).cast("double")).alias("share_up_to"))


# --- totals -----------------------------------------------------------------------------------------

def flag_cube(flags: DataFrame, by: list[str]) -> DataFrame:
    """Flags and documents in every combination of ``by``, totals included; ``level`` tells which columns are totals (their bits are set).

    A null in a column of a total row means "all"; ``level`` keeps it apart from values that are null.
    """
    return flags.cube(*by).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_flags"), F.count_distinct("document_id").alias("n_documents"))


# --- differences ---------------------------------------------------------------------------------------

def bag_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What turns one export into another, rows counted as often as they stand there.

    A row for each record whose number differs: ``n_removed`` or ``n_added``, and ``change``: ``changed`` where its key has both,
    else ``removed`` or ``added``. Copies are folded before the shuffle, so it is one pass over both sides
    however often a record repeats (``exceptAll`` would have to write every copy).
    """
    columns = old.columns
    both = old.withColumn("_n", F.lit(-1)).unionByName(new.select(columns).withColumn("_n", F.lit(1)))
    counted = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0)
    of_key = W.partitionBy(*keys)
    lost, gained = F.max((F.col("_n") < 0).cast("int")).over(of_key), F.max((F.col("_n") > 0).cast("int")).over(of_key)
    change = F.when(lost + gained == 2, F.lit("changed")).when(F.col("_n") < 0, F.lit("removed")).otherwise(F.lit("added"))
    return counted.select(*columns, change.alias("change"), F.greatest(-F.col("_n"), F.lit(0)).alias("n_removed"), F.greatest("_n", F.lit(0)).alias("n_added"))


def unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records that stand in both exports, as often as in the one that has fewer."""
    return old.intersectAll(new.select(old.columns))


# --- quality counters -------------------------------------------------------------------------------------

def counted(rows: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``rows`` with counters that are filled while they are written: no second pass over them.

    Each counter is a condition; ``rows`` counts all. Read them off the observation after the action.
    """
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counters.items()]), seen


# --- states of a past moment ---------------------------------------------------------------------------------

def validity(history: DataFrame, keys: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """Versions with the time at which the next one of the same key replaced them (``valid_to``, null for the current one).

    Of versions of one instant the highest ``seq`` holds. A window over a whole key would sort a hot key in one
    task, so versions are ordered inside (key, time bucket); the first of each later bucket closes the last of the one before.
    """
    rest = [c for c in history.columns if c not in (*keys, "ts")]
    last = history.groupBy(*keys, "ts").agg(F.max_by(F.struct(*rest), "seq").alias("_v"))
    at = last.withColumn("_b", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (bucket_seconds * 1_000_000)))
    inside = at.withColumn("_next", F.lead("ts").over(W.partitionBy(*keys, "_b").orderBy("ts")))
    starts = at.groupBy(*keys, "_b").agg(F.min("ts").alias("_first"))
    after = starts.select(*keys, "_b", F.lead("_first").over(W.partitionBy(*keys).orderBy("_b")).alias("_after"))
    return inside.join(after, [*keys, "_b"]).select(*keys, F.col("ts").alias("valid_from"), F.coalesce("_next", "_after").alias("valid_to"), "_v.*")


def as_of(moments: DataFrame, versions: DataFrame, keys: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """The version of each key that held at each moment (``ts``); moments before the first version have nulls.

    An interval join within time buckets: an interval goes to those buckets of its key that hold moments, and there are at
    most as many of these as days. A moment at which a version begins sees that version.
    """
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (bucket_seconds * 1_000_000))
    asked = moments.withColumn("_b", bucket(F.col("ts")))
    days = asked.groupBy(*keys).agg(F.collect_set("_b").alias("_days"))
    ends = F.coalesce(bucket(F.col("valid_to")), F.lit(2**62))
    spread = versions.join(days, keys).withColumn("_b", F.explode(F.filter("_days", lambda b: (b >= bucket(F.col("valid_from"))) & (b <= ends)))).drop("_days")
    same = [F.col(f"m.{k}") == F.col(f"v.{k}") for k in (*keys, "_b")]
    held = (F.col("m.ts") >= F.col("v.valid_from")) & (F.col("v.valid_to").isNull() | (F.col("m.ts") < F.col("v.valid_to")))
    rest = [c for c in versions.columns if c not in keys]
    on = held
    for condition in same:
        on = on & condition
    joined = asked.alias("m").join(spread.alias("v"), on, "left")
    return joined.select(*[F.col(f"m.{c}") for c in moments.columns], *[F.col(f"v.{c}") for c in rest if c != "seq"])
