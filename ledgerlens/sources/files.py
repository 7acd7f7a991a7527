"""Stored files and mail parts: scan, type detection, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.constants import (
    ALLOWED_MIME_TYPES, MAGIC_HEX, MIME_BY_SUFFIX, RIFF_HEX, UPLOAD_CAP_BYTES, WEBP_HEX,
)


def scan_documents(spark: SparkSession, path: str, pattern: str = "*", with_content: bool = True) -> DataFrame:
    """Stored documents, one folder per document id.

    Without ``with_content`` the bytes are pruned from the scan and only the listing
    is read. ``header_hex`` needs the first bytes only but still reads the file. Spark's
    source passes over files without a byte.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return named_files(files, with_content)


def named_files(files: DataFrame, with_content: bool = True) -> DataFrame:
    """Id, name, size and header of ``binaryFile`` rows, batch or streaming."""
    parts = [
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("document_id"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
    ]
    if with_content:
        parts += [F.hex(F.substring("content", 1, 12)).alias("header_hex"), F.col("content")]
    return files.select(*parts)


def detect_mime(header_hex: Column) -> Column:
    """Type from the first twelve bytes; null when none matches.

    A RIFF container counts only when it says WEBP at byte 8.
    """
    found = F.lit(None).cast("string")
    for magic, mime in reversed(MAGIC_HEX):
        found = F.when(header_hex.startswith(magic), F.lit(mime)).otherwise(found)
    webp = header_hex.startswith(RIFF_HEX) & (F.substring(header_hex, 17, 8) == WEBP_HEX)
    return F.when(webp, F.lit("image/webp")).otherwise(found)


def declared_type(declared: Column, filename: Column) -> Column:
    """Declared type, or the type of the suffix for an unspecific declaration (S3)."""
    suffixes = F.create_map(*[F.lit(x) for pair in MIME_BY_SUFFIX.items() for x in pair])
    suffix = F.lower(F.regexp_extract(filename, r"(\.[^./]+)$", 1))
    generic = F.coalesce(declared, F.lit("application/octet-stream"))
    return F.when(generic == "application/octet-stream",
                  F.coalesce(F.try_element_at(suffixes, suffix), generic)).otherwise(generic)


def admit_files(files: DataFrame, cap_bytes: int = UPLOAD_CAP_BYTES) -> DataFrame:
    """Every file with its type or the reason it is refused.

    Needs ``filename, declared_mime, header_hex, size_bytes``. Refused rows stay, with
    ``reject_reason`` set, so one bad file never stops the rest.
    """
    mime = declared_type(F.col("declared_mime"), F.col("filename"))
    out = files.withColumns({"declared_type": mime, "detected_type": detect_mime(F.col("header_hex"))})
    reason = (
        F.when(F.col("size_bytes") > cap_bytes, F.lit("too large"))
        .when(F.col("size_bytes") == 0, F.lit("empty"))
        .when(~F.col("declared_type").isin(*ALLOWED_MIME_TYPES), F.lit("declared type not allowed"))
        .when(F.col("detected_type").isNull(), F.lit("content not recognised"))
        .when(~F.col("detected_type").isin(*ALLOWED_MIME_TYPES), F.lit("content type not allowed"))
    )
    return out.withColumns({
        "reject_reason": reason,
        "mime_mismatch": reason.isNull() & (F.col("declared_type") != F.col("detected_type"))})


def admit_attachments(parts: DataFrame, subject_filter: str | None = None, cap_bytes: int = UPLOAD_CAP_BYTES) -> DataFrame:
    """Message parts with the reason they are skipped, null for attachments to process."""
    disposition = F.lower(F.coalesce("disposition", F.lit("")))
    subject = F.lower(F.coalesce("subject", F.lit("")))
    reason = F.when(F.lower("mime_type").startswith("multipart/"), F.lit("container"))
    if subject_filter:
        reason = F.when(~F.contains(subject, F.lit(subject_filter.lower())), F.lit("subject does not match")).when(
            F.lower("mime_type").startswith("multipart/"), F.lit("container"))
    reason = (
        reason.when(~F.contains(disposition, F.lit("attachment")), F.lit("not an attachment"))
        .when(F.coalesce("filename", F.lit("")) == "", F.lit("no file name"))
        .when(~F.lower("mime_type").isin(*ALLOWED_MIME_TYPES), F.lit("type not allowed"))
        .when(F.coalesce("size_bytes", F.lit(0)) == 0, F.lit("empty"))
        .when(F.col("size_bytes") > cap_bytes, F.lit("too large"))
    )
    return parts.withColumns({
        "reject_reason": reason, "mime_type": F.lower("mime_type"),
        "sender": F.coalesce("sender", F.lit("unknown")), "subject": F.coalesce("subject", F.lit("(no subject)"))})


def admitted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject_reason").isNull())


def refused(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject_reason").isNotNull())
