"""How filters act together: step counts of every order, and exact Shapley values.

Every document is reduced to a mask of the filters it fails. The removals v(S) of all coalitions S of filters (32 of five)
follow from the counts by mask, so one pass over the texts serves every order:

* the filter that follows the set S in an order removes v(S with it) - v(S);
* Shapley values are the exact solution of the least squares problem that fits v by a sum over members, with kernel weights
  (n - 1) / (C(n, s) s (n - s)) for coalitions of s of n filters and the constraint that the values sum to v(all). Its normal
  equations, bordered by the constraint, are solved in rationals.

Filters are column conditions, and one that looks at the whole table: copies, failed by a document whose text an other
one with a smaller id has. Texts are known by a SHA-256 digest. A group of copies is counted by (digest, part, mask, label) before it is
shuffled, so its size is no matter; a part is 32 cells in the end.

Null texts are empty texts, null parts the empty string. Documents with a null id count, fail no copies filter and have no label. Rows
that repeat an id each count; none of them is smaller than another. A document is good (toxic) where any of its label rows says 1; label rows
of a null id or of no document change nothing. Very long texts are read whole, word by word, in the JVM. An empty table gives an empty result.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledgerlens.llm.common import table
from ledgerlens.plans.registry import Query

SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts answered in one Arrow batch.
PARTS = 64


def text_rules(text: Column) -> dict[str, Column]:
    """The failure conditions of the column filters, by letter."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def tabulate(docs: DataFrame, rules: dict[str, Column], labels: DataFrame, copies: str = "E", doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail; bit i is the i-th of ``rules``, the last bit the copies filter.

    ``rules`` are conditions over the column ``text``, where null texts are empty already.
    """
    if copies in rules:
        raise ValueError(f"two filters are named {copies}")
    last = 1 << len(rules)
    plain = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(rules.values())]
    rows = plain.select("id", "part", F.sha2("text", 256).alias("digest"), sum(bits, F.lit(0)).alias("mask"))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    judged = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").where("id is not null").groupBy("id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    known = rows.where("id is not null").groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")).join(judged, "id", "left")
    known = known.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")})
    groups = known.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    # one row for each part and label of a text: the smallest id of all is no copy
    least = F.min("first.id").over(W.partitionBy("digest"))
    spared = F.when(F.col("first.id") == least, F.col("first.n")).otherwise(F.lit(0))
    split = groups.withColumn("spared", spared).select("part", "good", "toxic", F.inline(F.array(
        F.struct("mask", F.col("spared").alias("n")), F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))))
    nameless = rows.where("id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "mask", "n")
    cells = split.unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return cells


def kernel_solver(n: int) -> tuple[list[Fraction], list[list[Fraction]]]:
    """Kernel weight of every coalition, and the inverse of the bordered normal equations."""
    weight = [Fraction(0)] * (1 << n)
    for s in range(1, (1 << n) - 1):
        k = s.bit_count()
        weight[s] = Fraction(n - 1, comb(n, k) * k * (n - k))
    both = lambda i, j: sum((w for s, w in enumerate(weight) if s >> i & 1 and s >> j & 1), Fraction(0))
    rows = [[both(i, j) for j in range(n)] + [Fraction(1)] for i in range(n)] + [[Fraction(1)] * n + [Fraction(0)]]
    size = n + 1
    work = [r + [Fraction(int(i == j)) for j in range(size)] for i, r in enumerate(rows)]
    for i in range(size):
        pivot = next(r for r in range(i, size) if work[r][i])
        work[i], work[pivot] = work[pivot], work[i]
        work[i] = [x / work[i][i] for x in work[i]]
        for r in range(size):
            if r != i and work[r][i]:
                work[r] = [x - work[r][i] * y for x, y in zip(work[r], work[i], strict=True)]
    return weight, [r[size:] for r in work]


def shapley_values(removed: list[int], n: int, solver: tuple) -> list[Fraction]:
    """Values of the ``n`` filters from the removals of all coalitions."""
    weight, inverse = solver
    right = [sum((weight[s] * removed[s] for s in range(1 << n) if s >> i & 1), Fraction(0)) for i in range(n)] + [Fraction(removed[-1])]
    return [sum((a * b for a, b in zip(inverse[i], right, strict=True)), Fraction(0)) for i in range(n)]


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _orders(letters: str):
    n = len(letters)

    def coalitions(count: list[int]) -> list[int]:
        # documents that fail a member of S are those that do not fail within the rest alone
        inside = list(count)
        for i in range(n):
            for s in range(1 << n):
                if s >> i & 1:
                    inside[s] += inside[s ^ (1 << i)]
        full = (1 << n) - 1
        return [inside[full] - inside[full ^ s] for s in range(1 << n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, orders = kernel_solver(n), list(permutations(range(n)))
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS):
                out: dict[str, list] = {c: [] for c in ("part", "filter_order", "step", *COUNTS)}
                for row in batch.slice(lo, PARTS).to_pylist():
                    counts = {c: [0] * (1 << n) for c in ("n", "good", "toxic")}
                    for cell in row["cells"]:
                        for c, values in counts.items():
                            values[cell["mask"]] += cell[c]
                    v, good, toxic = (coalitions(counts[c]) for c in ("n", "good", "toxic"))
                    total = sum(counts["n"])
                    value = [x * factorial(n) for x in shapley_values(v, n, solver)]
                    for order in orders:
                        seen = 0
                        for step, i in enumerate(order, 1):
                            now = seen | 1 << i
                            took = v[now] - v[seen]
                            made = (total - v[now], took, v[1 << i] - took, counts["n"][1 << i], good[now] - good[seen], toxic[now] - toxic[seen], int(value[i]))
                            for c, x in zip(("part", "filter_order", "step", *COUNTS), (row["part"], "".join(letters[k] for k in order), step, *made), strict=True):
                                out[c].append(x)
                            seen = now
                types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], list(out))
    return run


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the filters and step, from the counts by mask; ``shapley`` is summed over all orders.

    A part is at most one cell for each mask, so gathering them is bounded.
    """
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(_orders(letters), "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by language."""
    rules = text_rules(F.col("text"))
    cells = tabulate(table(spark, sf_dir, "documents"), rules, table(spark, sf_dir, "labels"))
    return audit(cells, "".join(rules) + "E")


_FAILS = r"""select part, good, toxic, (case when len(words) < 100 then 1 else 0 end) + (case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 4 else 0 end) + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
    + (case when doc_id > first_id then 16 else 0 end) as mask
  from (select d.doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
          min(d.doc_id) over (partition by coalesce(text, '')) as first_id, coalesce(good, 0) as good, coalesce(l.toxic, 0) as toxic
        from documents d left join (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
                                    from labels group by doc_id) l on l.doc_id = d.doc_id) w"""
_ORDERS = " cross join ".join(f"(values ('A'), ('B'), ('C'), ('D'), ('E')) t{i}(x{i})" for i in range(1, 6))
#: Every order applied step by step to the counts; Shapley values as sums of the removals of all orders.
ORACLE = f"""
with cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from ({_FAILS}) f group by part, mask),
orders as (select x1 || x2 || x3 || x4 || x5 as filter_order from {_ORDERS}
  where x1 not in (x2, x3, x4, x5) and x2 not in (x3, x4, x5) and x3 not in (x4, x5) and x4 <> x5),
steps as (select filter_order, step, ascii(substr(filter_order, step, 1)) - 65 as letter, (1 << (ascii(substr(filter_order, step, 1)) - 65)) as bit,
  list_sum(list_transform(range(1, step), lambda i: (1 << (ascii(substr(filter_order, i, 1)) - 65)))) as before
  from (select filter_order, unnest([1, 2, 3, 4, 5]) as step from orders) o),
runs as (select part, filter_order, step, letter,
  sum(case when (mask & (coalesce(before, 0) + bit)) = 0 then n else 0 end) as kept,
  sum(case when (mask & bit) <> 0 and (mask & coalesce(before, 0)) = 0 then n else 0 end) as removed,
  sum(case when (mask & bit) <> 0 and (mask & coalesce(before, 0)) <> 0 then n else 0 end) as redundant,
  sum(case when mask = bit then n else 0 end) as unique_fails,
  sum(case when (mask & bit) <> 0 and (mask & coalesce(before, 0)) = 0 then good else 0 end) as good_lost,
  sum(case when (mask & bit) <> 0 and (mask & coalesce(before, 0)) = 0 then toxic else 0 end) as toxic_lost
  from cells cross join steps group by part, filter_order, step, letter)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from runs
"""

QUERIES = {"op13_filter_interactions": Query(filter_interactions, ORACLE)}
