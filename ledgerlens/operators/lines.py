"""Text lines of documents: building, de-duplicating, joining back to text, scoring.

Line table: ``document_id, page, line_idx, text, x0, y0, x1, y1, ocr_confidence``;
``line_idx`` orders the lines of a document across its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.constants import DENSE_TEXT_CHARS, RENDER_DPI, UNKNOWN_QUALITY
from ledgerlens.functions.text import strip

BOX = ["x0", "y0", "x1", "y1"]


def split_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """Non-blank lines of plain text with their position."""
    lines = documents.select("document_id", F.posexplode(F.split(text, "\n")).alias("line_idx", "text"))
    return lines.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")


def valid_boxes(lines: DataFrame) -> DataFrame:
    """Drop degenerate boxes (P17) instead of failing on them."""
    return lines.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("page") >= 1))


def rejected_boxes(lines: DataFrame) -> DataFrame:
    good = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("page") >= 1)
    return lines.filter(~F.coalesce(good, F.lit(False)))


def dedupe_elements(elements: DataFrame, order: list[str]) -> DataFrame:
    """First occurrence of each (text, rounded x0, rounded y0) on a page.

    ``min_by`` over ``order`` combines map-side and picks the earliest row;
    ``dropDuplicates`` would keep an arbitrary one. Rounding is half-to-even.
    """
    keys = ["document_id", "page", "text"]
    rest = [c for c in elements.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    grouped = elements.groupBy(*keys, F.bround("x0").alias("_x"), F.bround("y0").alias("_y")).agg(first)
    return grouped.select(*keys, "_first.*").select(*elements.columns)


def page_elements(words: DataFrame, lines: DataFrame, dpi: float = RENDER_DPI) -> DataFrame:
    """Words first, then whole lines, de-duplicated and scaled from points to pixels.

    Inputs hold ``document_id, page, seq, text`` and a box in points; ``level`` is 0
    for words and 1 for lines in the result.
    """
    columns = ["document_id", "page", "level", "seq", "text", *BOX]
    both = words.withColumn("level", F.lit(0)).select(columns).unionByName(
        lines.withColumn("level", F.lit(1)).select(columns))
    both = both.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    scale = F.lit(dpi) / F.lit(72.0).cast("double")
    kept = dedupe_elements(both, ["level", "seq"])
    return kept.withColumns({c: F.col(c) * scale for c in BOX} | {"ocr_confidence": F.lit(1.0)})


def is_dense(text: Column, chars: int = DENSE_TEXT_CHARS) -> Column:
    return F.coalesce(F.length(strip(text)) > chars, F.lit(False))


def dense_page_split(pages: DataFrame, embedded: DataFrame, recognised: DataFrame) -> DataFrame:
    """Lines to use per page (S6): embedded ones where the page's own text is dense,
    recognised ones elsewhere. Adds ``line_source``."""
    flags = pages.select("document_id", "page", is_dense(F.col("embedded_text")).alias("_dense"))
    tagged = embedded.withColumn("line_source", F.lit("embedded")).unionByName(
        recognised.withColumn("line_source", F.lit("recognised")))
    wanted = F.when(F.col("_dense"), F.lit("embedded")).otherwise(F.lit("recognised"))
    return tagged.join(flags, ["document_id", "page"]).filter(F.col("line_source") == wanted).drop("_dense")


def page_text(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Text of each page (P1): its embedded text when there is one, else its lines.

    A page is the unit that is gathered; its size is that of one sheet.
    """
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), "\n")
    texts = lines.groupBy("document_id", "page").agg(joined.alias("page_text"))
    if pages is None:
        return texts
    own = pages.select("document_id", "page", F.nullif("embedded_text", F.lit("")).alias("_own"))
    return own.join(texts, ["document_id", "page"], "full").select(
        "document_id", "page", F.coalesce("_own", "page_text", F.lit("")).alias("page_text"))


def document_text(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Whole text per document, pages joined by a form feed.

    The result is one string per document by definition, so this is for what a
    model reads in one call; :func:`page_text` is the form for anything larger.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page", "page_text")))
    return page_text(lines, pages).groupBy("document_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["page_text"]), "\f").alias("ocr_text"))


def first_pages(pages: DataFrame) -> DataFrame:
    """The page image a provider sees."""
    return pages.filter(F.col("page") == 1)


def doc_quality(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Mean line confidence, three decimals; 0.5 without lines (A1)."""
    mean = lines.groupBy("document_id").agg(F.avg("ocr_confidence").alias("_mean"))
    return documents.select("document_id").join(mean, "document_id", "left").select(
        "document_id", F.coalesce(F.round("_mean", 3), F.lit(UNKNOWN_QUALITY)).alias("quality"))


def doc_profile(lines: DataFrame) -> DataFrame:
    """Pages, lines and characters of the joined text per document."""
    per_page = lines.groupBy("document_id", "page").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return per_page.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n_lines"),
        (F.sum("chars") + F.sum("n") - 1).alias("n_chars"))
