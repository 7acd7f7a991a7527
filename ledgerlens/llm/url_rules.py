"""URL filter rules as a sort-merge range join over reversed-host keys.

The host ``blog.example.com`` has the key ``com.example.blog.``. A rule for ``example.com``
covers exactly the keys that start with ``com.example.``: an interval of the sorted keys, and
intervals of two rules are nested or apart. Rules and urls are sorted together; one sweep keeps
the rules whose intervals are open on a stack and reads a url's candidates off it.

The key range is cut at bounds taken from a sample of the urls (a salt follows the key, so a
host or url that holds a third of all rows is cut as well). A rule goes to every range its
interval reaches; only rules that cover a bound reach more than one. A task streams its range and
holds the open rules, one set for each label of a host.

A rule (host, path, verdict) fits the host and its subdomains where the url's path starts with the
rule's. The longest host + path wins, then the longer host, then ``block`` before other verdicts.

Null urls and urls without ``://`` have an empty host and path. Null hosts or paths of rules are
empty (they fit everything). Repeated urls each get a row, repeated rules change nothing. Empty
tables: without rules every url gets the default; without urls the result is empty. The columns of
``urls`` are kept as they are; ``host``, ``path``, ``rule`` and ``verdict`` replace columns of these names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerlens.llm.common import ascii_lower, table
from ledgerlens.plans.registry import Query

#: Rows sampled to cut the key range into partitions; nothing else depends on the sample.
BOUND_SAMPLE = 8192
OUT = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _bounds(keyed: DataFrame, parts: int) -> list[tuple[str, int]]:
    # one key for each of so many hash cells: a bounded sample, taken before anything reaches the driver
    cell = F.pmod("salt", F.lit(BOUND_SAMPLE))
    picked = keyed.groupBy(cell).agg(F.min_by("key", F.struct("salt", "key")).alias("key")).collect()
    # salts of the sample are spread evenly, so that equal keys can be cut
    step = 2**64 // max(1, len(picked))
    ordered = sorted((r["key"], -(2**63) + (i * step)) for i, r in enumerate(picked))
    return [ordered[len(ordered) * i // parts] for i in range(1, parts)] if ordered else []


def _ranges(bounds: list[tuple[str, int]]):
    """Which range a url belongs to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(bounds, k) for k in zip(b.column("key").to_pylist(), b.column("salt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "part"])
    return run


def _reached(bounds: list[tuple[str, int]]):
    """All ranges that a rule's interval reaches."""
    keys = [k for k, _ in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            for i, k in enumerate(b.column("key").to_pylist()):
                # the last key that starts with k is before k + the highest character
                for part in range(bisect_right(bounds, (k, -(2**63) - 1)), bisect_left(keys, k + "\U0010ffff") + 1):
                    rows.append(i)
                    parts.append(part)
            taken = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(parts, pa.int32())], [*taken.schema.names, "part"])
    return run


class _Sweep:
    """The open rules, outermost first: (key prefix, host length, {path: (rule, verdict)}, path lengths)."""

    def __init__(self) -> None:
        self.part, self.open = None, []

    def move(self, part: int, key: str) -> None:
        if part != self.part:
            self.part, self.open = part, []
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, part: int, key: str, host: str, path: str, verdict: str) -> None:
        self.move(part, key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, len(host), {}, []))
        _, _, paths, lengths = self.open[-1]
        if path not in paths or (verdict != "block") < (paths[path][1] != "block"):
            paths[path] = (host + path, verdict)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def judge(self, part: int, key: str, path: str):
        self.move(part, key)
        best, size = None, (-1, -1)
        for _, host, paths, lengths in self.open:
            for n in lengths:
                if n <= len(path) and path[:n] in paths:
                    if (host + n, host) > size:
                        best, size = paths[path[:n]], (host + n, host)
                    break
        return best


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep()
        for b in batches:
            col = {n: b.column(n).to_pylist() for n in ("part", "key", "is_url", "host", "path", "given")}
            rows, rule, verdict = [], [], []
            for i, (part, key, is_url, host, path, given) in enumerate(zip(*col.values(), strict=True)):
                if not is_url:
                    sweep.add(part, key, host, path, given)
                    continue
                best = sweep.judge(part, key, path)
                rows.append(i)
                rule.append(best and best[0])
                verdict.append(best[1] if best else default)
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("row"), kept.column("host"), kept.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["row", *OUT])
    return run


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule and verdict; ``rules`` has host, path and verdict."""
    spark = urls.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keep = [c for c in urls.columns if c not in OUT]
    host, path = host_and_path(F.col(url))
    row = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(1).alias("_none"))
    plain = [F.col(f.name) for f in urls.schema if isinstance(f.dataType, T.AtomicType)]  # a url of its own has no other salt
    keyed = urls.select(row.alias("row"), host.alias("host"), path.alias("path"), F.xxhash64(*plain).alias("salt"))
    keyed = keyed.select("row", "host", "path", host_key(F.col("host")).alias("key"), "salt")
    bounds = _bounds(keyed, parts)
    keyed = keyed.mapInArrow(_ranges(bounds), T.StructType([*keyed.schema.fields, T.StructField("part", T.IntegerType())]))
    empty = F.lit("")
    given = rules.select(ascii_lower(F.coalesce("host", empty)).alias("host"), F.coalesce("path", empty).alias("path"), F.coalesce("verdict", F.lit("block")).alias("given")).distinct()
    given = given.withColumn("key", F.when(F.col("host") == "", "").otherwise(host_key(F.col("host"))))
    given = given.mapInArrow(_reached(bounds), T.StructType([*given.schema.fields, T.StructField("part", T.IntegerType())]))
    both = keyed.select("part", "key", F.lit(True).alias("is_url"), "host", "path", F.lit(None).cast("string").alias("given"), "row", "salt").unionByName(
        given.withColumn("is_url", F.lit(False)), allowMissingColumns=True)
    swept = both.repartition(parts, "part").sortWithinPartitions("part", "key", "is_url", "salt").drop("salt")
    schema = T.StructType([both.schema["row"], *[T.StructField(n, T.StringType()) for n in OUT]])
    out = swept.mapInArrow(_sweep(default), schema)
    return out.select(*([F.col("row")[c].alias(c) for c in keep]), *OUT)


#: The rules of the registered query.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


def judged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the five rules; allowed where no rule fits."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", *OUT, "url")


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"


_LONGEST = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
ORACLE = f"""
with r as (select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r)
select page_id, host, path,
       case {" ".join(f"when {_fits(h, p)} then '{h}{p}'" for h, p, _ in _LONGEST)} end as rule,
       case {" ".join(f"when {_fits(h, p)} then '{v}'" for h, p, v in _LONGEST)} else 'allow' end as verdict, url
from h
"""

QUERIES = {"op2_url_rules": Query(judged_pages, ORACLE)}
