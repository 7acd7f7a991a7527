"""Hard negatives: SQL, brute force in whole numbers, and the edge cases the module states."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives as hn
from tests.compare import check, duck

QUERY = hn.QUERIES["op11_residue_negatives"]
SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def test_query_equals_sql(spark, sf_dir):
    ok, note = check(spark, duck(sf_dir), sf_dir, "op11_residue_negatives", QUERY.run, QUERY.sql)
    assert ok, note


def held(x):
    return max(hn.LOWEST, min(hn.HIGHEST, x))


def brute(rows, is_anchor, positives=5, negatives=10):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows
              if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, tuple(q), y) for i, q, y in usable if is_anchor(i)}
    out = []
    for i, q, y in anchors:
        scored = [(-held(sum(a * b for a, b in zip(q, r, strict=True))), j, z) for j, r, z in usable if len(r) == len(q) and j != i]
        for s, j, z in sorted(x for x in scored if x[2] == y)[:positives]:
            window = sorted(x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(i, j, n, k, -s, -t) for n, (t, k, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, condition="vec_id % 10 = 0"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, hn.hard_negatives(df, F.expr(condition)).collect()))


def vectors(n, dim, seed, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dim))
    y = rng.integers(0, labels, n)
    x = centre[y] * 0.3 + rng.normal(size=(n, dim)) * 0.3 + 0.5
    return [(i, [float(np.float32(c)) for c in row], int(k)) for i, (row, k) in enumerate(zip(x, y, strict=True))]


def test_against_brute(spark):
    rows = vectors(160, 6, 1)
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0] * 6, 1), (1000, None, 1), (1010, [1.0] * 6, None), (1020, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1030, [nan] * 6, 0), (1040, [inf] * 6, 0)]
    rows += [(2000 + i, [1.0, 1.0], i % 2) for i in range(25)] + [(3000 + i, [], i % 2) for i in range(12)]
    rows += [rows[20], rows[20], (20, [0.25] * 6, 2), rows[33]]
    rows += [(4000 + i, [0.0] * 6, 0) for i in range(3)]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 300


def test_blocks_and_batches_change_nothing(spark, monkeypatch):
    rows = vectors(300, 5, 2, labels=2)
    rows = [(i, v, 0 if i % 3 else y) for i, v, y in rows] + [(1000 + i, rows[7][1], i % 2) for i in range(80)]
    expected = brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows) == expected
    monkeypatch.setattr(hn, "ANCHORS", 7)
    monkeypatch.setattr(hn, "ROWS", 40)
    monkeypatch.setattr(hn, "TILE", 64)
    assert mined(spark, rows) == expected


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    for size in (1e4, 1e9, 1e30):
        rows = [(i, [float(np.float32(rng.uniform(0.2, 1) * size)) for _ in range(3)], i % 3) for i in range(60)]
        assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_empty_results(spark):
    assert mined(spark, []) == []
    assert mined(spark, vectors(20, 3, 3), "vec_id < 0") == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []


@pytest.mark.parametrize(("dim", "size"), [(1, 1), (64, 256), (3000, 300), (5, 2**31), (7, 2**60), (3, 2**139)])
def test_residues_give_exact_products(dim, size):
    rng = random.Random(dim)
    a, b = ([[float(rng.randint(-size, size)) for _ in range(dim)] for _ in range(6)] for _ in range(2))
    m = hn.Moduli(dim, size, size)
    got = m.scores(m.residues(np.array(a)), m.residues(np.array(b)))
    assert got.tolist() == [[held(sum(int(x) * int(y) for x, y in zip(u, v, strict=True))) for v in b] for u in a]
    assert m.fits == (size <= 2**20)
