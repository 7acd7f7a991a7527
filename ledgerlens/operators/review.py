"""Human review: corrections, approvals, provenance, export gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators.frames import latest, with_columns_present

KEYS = ["document_id", "field_path"]
FIELD_TYPES = {"value_type": "string", "source_model": "string", "flagged": "boolean", "review_reason": "string"}


def latest_results(results: DataFrame, order: tuple[str, ...] = ("updated_at", "seq")) -> DataFrame:
    """Current version of every result."""
    return latest(results, ["result_id"], list(order))


def apply_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Field rows after the latest correction of each field.

    A corrected field has the reviewer's value, confidence 1, source ``human`` and no
    flag; its other columns stay. A field the extraction missed is created. Applying
    the same corrections again changes nothing.
    """
    fields = with_columns_present(fields, FIELD_TYPES)
    last = latest(corrections.select(*KEYS, "corrected_value", "seq"), KEYS, ["seq"])
    joined = fields.join(last.drop("seq").withColumn("_fixed", F.lit(True)), KEYS, "full")
    fixed = F.coalesce("_fixed", F.lit(False))
    out = joined.withColumns({
        "value": F.when(fixed, F.col("corrected_value")).otherwise(F.col("value")),
        "value_type": F.when(fixed, F.lit("string")).otherwise(F.col("value_type")),
        "confidence": F.when(fixed, F.lit(1.0)).otherwise(F.col("confidence")),
        "source_model": F.when(fixed, F.lit("human")).otherwise(F.col("source_model")),
        "flagged": F.when(fixed, F.lit(False)).otherwise(F.coalesce("flagged", F.lit(False))),
        "review_reason": F.when(~fixed, F.col("review_reason")),
    })
    return out.select(*fields.columns)


def unknown_corrections(corrections: DataFrame, results: DataFrame) -> DataFrame:
    """Corrections to a document without a result (the reject table of J11)."""
    return corrections.join(results.select("document_id").distinct(), "document_id", "left_anti")


def correction_history(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Each correction with what it replaced (J14): labelled before/after pairs.

    The first correction of a field replaces the extraction, a later one the previous
    correction; corrections of one field are few, extraction rows are unique per field.
    """
    from pyspark.sql import Window as W

    fields = with_columns_present(fields, {**FIELD_TYPES, "raw_text": "string"})
    before = fields.select(*KEYS, F.col("value").alias("extracted_value"), F.col("confidence").alias("extracted_confidence"),
                           F.col("source_model").alias("extracted_source"), "raw_text")
    turns = W.partitionBy(*KEYS).orderBy("seq")
    joined = corrections.withColumn("_turn", F.row_number().over(turns)).withColumn(
        "_previous", F.lag("corrected_value").over(turns)).join(before, KEYS, "left")
    again = F.col("_turn") > 1
    return joined.select(
        *[c for c in corrections.columns],
        F.when(again, F.col("_previous")).otherwise(F.col("extracted_value")).alias("original_value"),
        F.when(again, F.lit(1.0)).otherwise(F.col("extracted_confidence")).alias("original_confidence"),
        F.when(again, F.lit("human")).otherwise(F.col("extracted_source")).alias("original_source"),
        "raw_text")


def approve_fields(fields: DataFrame, approved: DataFrame) -> DataFrame:
    """Confirm values as they are.

    ``approved(document_id, field_path)``; a null path confirms every flagged field of
    the document. Names without an extraction row have no effect.
    """
    fields = with_columns_present(fields, FIELD_TYPES)
    single = approved.filter(F.col("field_path").isNotNull()).select(*KEYS).distinct().withColumn("_one", F.lit(True))
    whole = approved.filter(F.col("field_path").isNull()).select("document_id").distinct().withColumn("_all", F.lit(True))
    joined = fields.join(single, KEYS, "left").join(whole, "document_id", "left")
    ok = F.coalesce("_one", F.lit(False)) | (F.coalesce("_all", F.lit(False)) & F.coalesce("flagged", F.lit(False)))
    return joined.withColumns({
        "confidence": F.when(ok, F.lit(1.0)).otherwise(F.col("confidence")),
        "source_model": F.when(ok, F.lit("human")).otherwise(F.col("source_model")),
        "flagged": ~ok & F.coalesce("flagged", F.lit(False)),
        "review_reason": F.when(~ok, F.col("review_reason")),
    }).select(*fields.columns)


def remaining_flags(flagged: DataFrame, fields: DataFrame) -> DataFrame:
    """What is left to review per document (U2, A11): flagged pairs minus confirmed ones.

    ``flagged`` comes from ``assemble.flagged_rows``. Cleared documents keep a row.
    """
    human = fields.filter(F.col("source_model") == "human").select(*KEYS).withColumn("_done", F.lit(True))
    left = F.when(F.col("_done").isNull(), F.col("field_path"))
    return flagged.select(*KEYS).distinct().join(human, KEYS, "left").groupBy("document_id").agg(
        F.array_sort(F.collect_set(left)).alias("fields_remaining")).withColumn(
        "all_cleared", F.size("fields_remaining") == 0)


def current_approval(approvals: DataFrame) -> DataFrame:
    """Latest decision per document."""
    return latest(approvals, ["document_id"], ["seq"])


def export_gate(results: DataFrame, approvals: DataFrame, flags: DataFrame, force: bool = False) -> DataFrame:
    """Which results may be exported (P15): approved ones, or all with ``force``.

    Approval alone opens the gate; open flags and errors do not close it. A refused
    row lists its pending fields and error rules. ``results(document_id, fields_flagged)``.
    """
    status = F.coalesce("status", F.lit("pending"))
    errors = flags.filter(F.col("severity") == "error").groupBy("document_id").agg(
        F.array_sort(F.collect_set(F.split_part("rule", F.lit(":"), F.lit(1)))).alias("error_rules"))
    decided = results.join(current_approval(approvals).select("document_id", "status"), "document_id", "left").join(
        errors, "document_id", "left")
    ready = F.lit(True) if force else status == "approved"
    none = F.array().cast("array<string>")
    return decided.select(
        "document_id", status.alias("status"), ready.alias("ready"),
        F.when(~ready, F.coalesce("fields_flagged", none)).otherwise(none).alias("pending_fields"),
        F.when(~ready, F.coalesce("error_rules", none)).otherwise(none).alias("error_rules"))
