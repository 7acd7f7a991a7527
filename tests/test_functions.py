"""Scalar expressions on the known examples and the odd cases."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import numbers as N, text as T
from ledgerlens.functions.signing import hmac_sha256


def run(spark, values, expr, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_normalise(spark):
    got = run(spark, ["ACME Corp.", "Café & Co.", "New  York  City", "P.O. #12-345/A", "Straße ½ ﬁx", "a b"], T.normalise_text)
    assert got == ["acme corp", "cafe co", "new york city", "p o 12-345/a", "straße 1 2 fix", "a b"]


def test_numbers(spark):
    got = run(spark, ["1,234.56", "USD 1234", "1234 USD", "$1,234.56", "1.5k", "5d", "1_000", " 7 ", "", None, "-3e2", "1.234,56"], N.to_number)
    assert got == [1234.56, 1234.0, 1234.0, 1234.56, None, None, None, 7.0, None, None, -300.0, 1.23456]


def test_confidence(spark):
    got = run(spark, [None, "0.9", "90", "high", "-1", "1.5", "NaN", "250"], N.coerce_confidence)
    assert got == [0.5, 0.9, 0.9, 0.5, 0.0, 0.015, 0.5, 1.0]


@pytest.mark.parametrize("a,b,ok", [(100.00, 100.03, True), (100.00, 102.00, False), (0.10, 0.14, True), (0.10, 0.16, False)])
def test_tolerance(spark, a, b, ok):
    assert spark.range(1).select(N.within_tolerance(F.lit(a), F.lit(b))).first()[0] is ok


def test_dates(spark):
    got = run(spark, ["2024-01-15", "20240115", "2024/1/5", "15/01/2024", "2024", "12/5", "Jan 15, 2024", "2024-02-30", "", None,
                      "01/02/03", "2024-1-5"], N.parse_date)
    assert [str(g) if g else None for g in got] == [
        "2024-01-15", "2024-01-15", "2024-01-05", None, None, None, None, None, None, None, "0001-02-03", None]


def test_keys(spark):
    assert run(spark, ["ACME  Corp.", "1,234.56", "1234.56"], T.value_key) == ["acme corp", "123456", "123456"]
    assert run(spark, ["$ 1,500.00", "0045", "000", "€ 3"], T.number_key) == ["1500.00", "45", "0", "3"]


def test_strip_takes_every_blank(spark):
    assert run(spark, ["  x\t\n", " "], T.clean_string) == ["x", None]


def test_search_parts(spark):
    got = run(spark, ["1 Main Street, Townsville, DH9 OTB", "one two three four five", "a b", "x, yy, abc"], T.search_parts)
    assert got == [["1 Main Street", "Townsville", "DH9 OTB"], ["one two three", "four five"], None, ["abc"]]


def test_email_and_file_name(spark):
    assert run(spark, ["a@b.co", " a@b.co ", "a@b", "x"], T.is_email) == [True, True, False, False]
    assert run(spark, ["/etc/../p.pdf", "a.pdf", ""], lambda c: T.safe_file_name(c, F.lit(7))) == ["p.pdf", "a.pdf", "document_7"]


@pytest.mark.parametrize("secret", ["k", "a much longer secret " * 5])
def test_hmac(spark, secret):
    texts = ["", "hello", "größe"]
    want = [hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest() for t in texts]
    assert run(spark, texts, lambda c: hmac_sha256(c, secret)) == want
