"""Filter interactions: SQL, brute force over all orders, and the edge cases the module states."""

import random
import re
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import filter_audit
from tests.compare import check, duck

LETTERS = "ABCDE"
QUERY = filter_audit.QUERIES["op13_filter_interactions"]


def test_query_equals_sql(spark, sf_dir):
    ok, note = check(spark, duck(sf_dir), sf_dir, "op13_filter_interactions", QUERY.run, QUERY.sql)
    assert ok, note


def fails(rows):
    """The filters that each row fails, as a set of letters."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        got = set()
        if len(words) < 100:
            got.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            got.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            got.add("C")
        if re.search(r"[#$%&*|]", t):
            got.add("D")
        if i is not None and any(o is not None and o < i and (x or "") == t for o, x, _ in rows):
            got.add("E")
        out.append(got)
    return out


def brute(rows, labels):
    failed = fails(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, failed, strict=True) if (p or "") == part]
        total = dict.fromkeys(LETTERS, 0)
        for order in permutations(LETTERS):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                total[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, lang string, part string, mask int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("no"))
    cells = filter_audit.tabulate(docs, filter_audit.text_rules(F.col("text")), marks)
    got = filter_audit.audit(cells, LETTERS).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(found) == len(got)
    return found


def test_against_brute(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcXYZé𝒳") for _ in range(rng.randint(1, 6)))
    texts = [None, "", " \t\n", "a" * 200_000, "B" * 50, "a\x0bb\x1fc | d", "x " * 150]
    for _ in range(60):
        n = rng.choice([5, 99, 100, 101, 130])
        pool = [word() for _ in range(rng.choice([10, 79, 500]))]
        texts.append(" ".join(rng.choice(pool) for _ in range(n)) + rng.choice(["", " #", "  "]))
    rows = [(rng.choice([None, *range(80)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(300)]
    rows += [(3, "same", "en")] * 3 + [(4, "same", "fr"), (3, "same", "de")] + [(i, "copy " * 120, "en") for i in range(100, 160)]
    labels = [(rng.choice([None, *range(90)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(120)] * 2
    assert run(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    one = run(spark, [(1, None, None)], [])
    assert one == brute([(1, None, None)], []) and len(one) == 600


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_least_squares_equals_all_orders(n):
    rng = random.Random(n)
    removed = [0] + [rng.randint(0, 10**12) for _ in range((1 << n) - 1)]
    total = [0] * n
    orders = list(permutations(range(n)))
    for order in orders:
        seen = 0
        for i in order:
            total[i] += removed[seen | 1 << i] - removed[seen]
            seen |= 1 << i
    assert filter_audit.shapley_values(removed, n, filter_audit.kernel_solver(n)) == [Fraction(t, len(orders)) for t in total]


def test_a_letter_named_twice(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="named A"):
        filter_audit.tabulate(docs, filter_audit.text_rules(F.col("text")), docs, copies="A")
