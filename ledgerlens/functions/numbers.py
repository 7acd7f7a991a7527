"""Numeric and date coercions over untrusted text. Nothing here can raise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerlens.constants import (
    ABS_TOLERANCE, CURRENCY_CODE, CURRENCY_SYMBOLS, MISSING_CONFIDENCE, REL_TOLERANCE,
)
from ledgerlens.functions.text import strip

# sizes are bounded so that every match is a finite double
_DIGITS = r"[+-]?([0-9]{1,200}\.?[0-9]*|\.[0-9]+)([eE][+-]?0*[0-9]{1,2})?"
#: what counts as a number; keeps Java's ``5d`` and similar suffixes out
NUMBER = rf"^{_DIGITS}$"
_PLAIN = rf"^\s*{_DIGITS}\s*$"


def guarded_double(c: Column) -> Column:
    """Number text to double, anything else to null. The cast ignores outer blanks.

    Numbers of a hundred digits and more (``1e400``) are null too, so nothing
    downstream meets an infinity.
    """
    return F.when(c.rlike(_PLAIN), c.try_cast("double"))


def finite(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c)


def to_number(c: Column) -> Column:
    """Money text to double (F2): currency signs, three-letter codes and
    thousands commas removed; anything else left over gives null.

    Text that is a number already takes one pattern match and no cleaning.
    """
    bare = F.regexp_replace(F.regexp_replace(c, CURRENCY_SYMBOLS, ""), CURRENCY_CODE, "")
    cleaned = guarded_double(strip(F.replace(bare, F.lit(","), F.lit(""))))
    return F.when(c.rlike(_PLAIN), c.try_cast("double")).otherwise(cleaned)


def coerce_confidence(c: Column) -> Column:
    """Confidence text to [0, 1] (P8): null or non-number is 0.5, above one is a percentage."""
    x = guarded_double(c)
    scaled = F.when(x > 1.0, x / F.lit(100.0).cast("double")).otherwise(x)
    return F.when(x.isNull(), F.lit(MISSING_CONFIDENCE)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
    )


def within_tolerance(a: Column, b: Column) -> Column:
    """Money equality (F8): five cents or one percent of the larger, whichever is wider."""
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.abs(a - b) <= F.greatest(F.lit(ABS_TOLERANCE), F.lit(REL_TOLERANCE) * scale)


def parse_date(c: Column) -> Column:
    """ISO or compact date; slash dates are read year/month/day."""
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    compact = F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))
    ymd = F.split(c, "/")
    year, month, day = (F.lpad(strip(F.get(ymd, F.lit(i))), n, "0") for i, n in ((0, 4), (1, 2), (2, 2)))
    slash = F.when(
        c.rlike(r"^\s*\d{1,4}\s*/\s*\d{1,2}\s*/\s*\d{1,2}\s*$"),
        F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd"),
    )
    return F.coalesce(iso, compact, slash)


def exact_sum(c: Column) -> Column:
    """Order-independent sum of money held as double.

    Amounts that no decimal of this size holds, and sums beyond it, are added as doubles.
    """
    exact = c.try_cast("decimal(30,6)")
    inside = F.coalesce(F.try_sum(exact).cast("double"), F.sum(F.when(exact.isNotNull(), c)))
    outside = F.sum(F.when(exact.isNull(), c))
    return F.when(F.count(c) > 0, F.coalesce(inside, F.lit(0.0)) + F.coalesce(outside, F.lit(0.0)))


def plain_text(c: Column) -> Column:
    """A finite double in plain notation with all its digits and at least one decimal."""
    def shift(shown: Column) -> Column:
        sign = F.when(shown.startswith("-"), "-").otherwise("")
        bare = F.ltrim(shown, F.lit("-"))
        mantissa, power = F.substring_index(bare, "E", 1), F.substring_index(bare, "E", -1).try_cast("int")
        digits = F.concat(F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "^0$", ""))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        rest = F.substring(digits, power + 2, F.length(digits))
        large = F.concat(F.rpad(digits, power + 1, "0"), F.lit("."), F.when(rest == "", "0").otherwise(rest))
        return F.when(~shown.contains("E"), shown).otherwise(F.concat(sign, F.when(power < 0, small).otherwise(large)))

    # amounts of this size are shown in plain notation already
    size = F.abs(c)
    plain = (c == 0) | ((size >= 1e-3) & (size < 1e7))
    # the text is used many times over: bound once, it is made once
    return F.when(plain, c.cast("string")).otherwise(F.transform(F.array(finite(c).cast("string")), shift)[0])
