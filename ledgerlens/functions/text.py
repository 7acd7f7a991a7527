"""String column expressions. All of them stay in the JVM except accent folding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ledgerlens.constants import EMAIL_PATTERN


#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every kind of whitespace at both ends; looks at the ends only, where a pattern would try every blank."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def clean_string(c: Column) -> Column:
    """Trimmed text, null when nothing is left (F1)."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of whitespace become one blank; ends trimmed."""
    # a single blank is left alone: it is by far the commonest run
    return F.trim(F.regexp_replace(c, r"(?U)[^\S ]\s*|\s{2,}", " "))


@F.pandas_udf(T.StringType())
def _fold_accents(s: pd.Series) -> pd.Series:
    # decomposition leaves the base letters followed by their combining marks
    return s.str.normalize("NFKD").str.replace(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]", "", regex=True)


def fold_accents(c: Column) -> Column:
    """Compatibility-decompose and drop combining marks.

    Spark has no decomposition function. Only rows with a non-ASCII character
    carry a string to the Python worker; pure ASCII rows ship a null.
    """
    needs = c.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_fold_accents(F.when(needs, c)), c)


def normalise_text(c: Column) -> Column:
    """Form used for fuzzy matching (F3): no accents, lower case, punctuation
    other than ``-`` and ``/`` turned into a blank, whitespace collapsed."""
    lowered = F.lower(fold_accents(c))
    return squeeze(F.regexp_replace(lowered, r"(?U)[^\w\s\-/]", " "))


def value_key(c: Column) -> Column:
    """Equality key for comparing two passes."""
    return squeeze(F.regexp_replace(F.lower(c), "[,.]", ""))


def number_key(c: Column) -> Column:
    """Loose numeric key (F5): no separators, currency signs, blanks or leading zeros."""
    bare = F.regexp_replace(c, r"(?U)[,$€£\s]", "")
    return F.coalesce(F.nullif(F.regexp_replace(bare, "^0+", ""), F.lit("")), F.lit("0"))


def is_email(c: Column) -> Column:
    return strip(c).rlike(EMAIL_PATTERN)


def safe_file_name(c: Column, document_id: Column) -> Column:
    """Last path component; a name derived from the id when none is left."""
    name = F.regexp_extract(F.regexp_replace(c, "/+$", ""), "([^/]*)$", 1)
    return F.when(name.isin("", "."), F.concat(F.lit("document_"), document_id.cast("string"))).otherwise(name)


def search_parts(c: Column) -> Column:
    """Pieces of a multi-line value (F11): comma parts when there are two or
    more, else groups of three words; pieces under three characters dropped."""
    commas = F.filter(F.transform(F.split(c, ","), strip), lambda p: F.length(p) > 0)
    words = F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: F.length(w) > 0)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: i % 3 == 0)
    triples = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(3)), " "))
    multi = (F.size(commas) >= 2) | (F.size(words) >= 5)
    parts = F.when(F.size(commas) >= 2, commas).otherwise(triples)
    return F.when(multi, F.filter(parts, lambda p: F.length(p) >= 3))
