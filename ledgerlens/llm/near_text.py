"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of word shingles, as 64-bit hashes, and a signature of ``HASHES`` minima.
   Texts with equal sets are one class from here on, found by a digest of the set.
2. Signatures are cut into bands; classes that agree in a band share a bucket. Only buckets with two
   classes or more go on.
3. Candidate pairs are verified in steps of ``STEP`` hash values: a pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold falls below ``MISS``.
4. Survivors are verified exactly, on the full sets of their texts.

Links matter only for the components they make, so pairs are never written out. The first round
tests every member of a bucket against the bucket's smallest class: a row for each member. Classes
found to be linked become one component. The second round looks at buckets that still hold several
components: large ones are cut into blocks, each block of the minority meets each stretch of
the bucket in a group of bounded size, and a pair belongs to the first band it shares. Signatures name the classes of a group that have
surviving pairs; their texts are sent to the group, which tests all such pairs exactly and returns a link for each
two components it joins. Every surviving pair across components is tested, so no link is lost to a cap.

Null texts, empty texts and texts of spaces have no shingles and link with nothing; a text with fewer
words than a shingle is one shingle. Very long texts are read whole. Rows with a null id are returned with
a null component. Repeated rows are copies of each other; an empty table gives an empty result.
Ties go to the smallest id. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.common import components, lean, stored, table
from ledgerlens.plans.registry import Query

WORDS, THRESHOLD = 5, (80, 100)
#: Shingles of the registered query.
QUERY_WORDS = 4
BANDS, ROWS, STEP = 32, 4, 32
HASHES = BANDS * ROWS
#: Chance to drop a pair whose similarity reaches the threshold, at each step.
MISS = 1e-5
#: Classes of a bucket in one block, and members compared with a leader in one task's stretch.
BLOCK, LEADER_ROWS = 512, 512
#: Up to so many ids (16 MB) the ids of texts to be verified are sent to all tasks; beyond, they are joined by shuffle.
SEND_IDS = 1_000_000

_RANDOM = np.random.default_rng(7)
_FACTOR = (_RANDOM.integers(1, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_FLIP = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; A-Z lower-cased, words between ASCII spaces."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(h))
    mixed = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        # each word is folded in with a multiplication of its own, so order counts
        mixed = (mixed ^ h[k:len(h) - n + 1 + k]) * _MIX[k % 4]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        part = (x[None, at:at + 2048] ^ _FLIP[:, None]) * _FACTOR[:, None]
        np.minimum(out, part.min(1), out=out)
    return out


def least_matches(seen: int, threshold: float, miss: float) -> int:
    """Fewest equal values among ``seen`` at which the threshold is still likely enough (uniform prior)."""
    total = 0.0
    for m in range(seen + 1):
        # posterior Beta(m + 1, seen - m + 1): P(similarity >= t) = P(Binomial(seen + 1, t) <= m)
        total += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if total >= miss:
            return m
    return seen


def survivors(left: np.ndarray, right: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Equal values of each pair of signature rows, or -1 where a step dropped the pair."""
    got = np.zeros(len(left), np.int64)
    alive = np.arange(len(left))
    for i, least in enumerate(bounds):
        cols = slice(i * STEP, (i + 1) * STEP)
        got[alive] += (left[alive, cols] == right[alive, cols]).sum(1)
        drop = got[alive] < least
        got[alive[drop]] = -1
        alive = alive[~drop]
    return got


def _bounds(threshold: tuple[int, int], miss: float) -> list[int]:
    return [least_matches(n, threshold[0] / threshold[1], miss) for n in range(STEP, HASHES + 1, STEP)]


def linked(inter: int, a: int, b: int, threshold: tuple[int, int]) -> bool:
    return threshold[1] * inter >= threshold[0] * (a + b - inter)


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, digest, sign = [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, words)
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sign.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("version"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sign, pa.binary())],
                ["doc_id", "version", "n_shingles", "digest", "sign"])
    return run


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, HASHES)


def _test(threshold, miss: float):
    bounds = _bounds(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = survivors(_matrix(b.column("sign_a").to_pylist()), _matrix(b.column("sign_b").to_pylist()), bounds)
                keep = pa.array(np.flatnonzero(got >= 0))
                yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], ["a", "b"])
    return run


def _fits(threshold, a: str = "n_a", b: str = "n_b"):
    """Sets of such sizes can reach the threshold."""
    return F.least(a, b) * threshold[1] >= F.greatest(a, b) * threshold[0]


def _star_pairs(members: DataFrame, classes: DataFrame, threshold, miss: float) -> DataFrame:
    """Surviving pairs of each bucket's smallest class with its other members."""
    pairs = members.where("cls != lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    side = lambda n: classes.select(F.col("cls").alias(n), F.col("n_shingles").alias(f"n_{n}"), F.col("sign").alias(f"sign_{n}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(_fits(threshold))
    return both.select("a", "b", "sign_a", "sign_b").mapInArrow(_test(threshold, miss), "a bigint, b bigint")


def _surviving(sign: np.ndarray, size: int, comp: int, signs: np.ndarray, sizes: np.ndarray, comps: np.ndarray, band: int, threshold, bounds) -> tuple[np.ndarray, np.ndarray]:
    """Places of the classes of other components whose pair with ``sign`` survives and belongs to ``band``, and their matches."""
    at = np.flatnonzero((comps != comp) & (np.minimum(sizes, size) * threshold[1] >= np.maximum(sizes, size) * threshold[0]))
    if not len(at):
        return at, at
    equal = signs[at] == sign
    first = equal.reshape(len(at), BANDS, ROWS).all(2).argmax(1) == band
    at = at[first]
    got = survivors(np.broadcast_to(sign, (len(at), HASHES)), signs[at], bounds)
    return at[got >= 0], got[got >= 0]


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Runs of rows that agree in bucket, stretch and block."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if row[:3] != key:
                if rows:
                    yield rows
                key, rows = row[:3], []
            rows.append(row)
    if rows:
        yield rows


_GROUP = ["bucket", "stretch", "block", "band", "proposes", "cls", "comp"]
_GROUP_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
_GROUP_SCHEMA = "bucket bigint, stretch int, block int, band int, proposes boolean, cls bigint, comp bigint"


def _involved(threshold, miss: float):
    """The rows of each group that have a surviving pair."""
    bounds = _bounds(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, [*_GROUP, "n_shingles", "sign"]):
            asking, other = [r for r in rows if r[4]], [r for r in rows if not r[4]]
            if not asking or not other:
                continue
            comps, sizes = (np.array([r[i] for r in other], np.int64) for i in (6, 7))
            signs = _matrix([r[8] for r in other])
            found, touched = [], np.zeros(len(other), bool)
            for r in asking:
                at, _ = _surviving(np.frombuffer(r[8], np.uint32), r[7], r[6], signs, sizes, comps, r[3], threshold, bounds)
                if len(at):
                    found.append(r[:7])
                    touched[at] = True
            found += [other[i][:7] for i in np.flatnonzero(touched)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _GROUP_TYPES, strict=True)], _GROUP)
    return run


def _join_components(words: int, threshold, miss: float):
    """Links that join components, from all surviving pairs of each group."""
    bounds = _bounds(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, [*_GROUP, "text", "digest"]):
            ready = []
            for r in rows:
                s = shingles(r[7], words)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == r[8]:  # else another text under the same id
                    ready.append((r, s, signature(s)))
            asking, other = [x for x in ready if x[0][4]], [x for x in ready if not x[0][4]]
            if not asking or not other:
                continue
            comps, sizes = np.array([x[0][6] for x in other], np.int64), np.array([len(x[1]) for x in other], np.int64)
            signs = np.stack([x[2] for x in other])
            root: dict[int, int] = {}

            def find(c: int, root=root) -> int:
                while root.get(c, c) != c:
                    root[c] = root.get(root[c], root[c])
                    c = root[c]
                return c

            links = []
            for r, s, sign in asking:
                at, got = _surviving(sign, len(s), r[6], signs, sizes, comps, r[3], threshold, bounds)
                for i in at[np.argsort(-got, kind="stable")]:
                    a, b = find(r[6]), find(int(comps[i]))
                    if a != b and linked(len(np.intersect1d(s, other[i][1], assume_unique=True)), len(s), len(other[i][1]), threshold):
                        root[max(a, b)] = min(a, b)
                        links.append((r[5], other[i][0][5]))
            if links:
                yield _pairs(links)
    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    found = list(dict.fromkeys(found))
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _across(members: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame, words: int, threshold, miss: float) -> DataFrame:
    """Links (a, b) across components in buckets that hold several.

    All classes of a bucket outside its largest component propose. They are cut into blocks, all classes
    into stretches, and each block meets each stretch, so a group has two times ``BLOCK`` rows or so.
    """
    here = members.select("bucket", "band", "cls").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    parts = here.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    cut = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    open_ = open_.select("bucket", F.col("top.comp").alias("main"), cut(F.col("n")).alias("stretches"), cut(F.col("n") - F.col("top.n")).alias("blocks"))
    rows = here.join(open_, "bucket").join(classes.select("cls", "n_shingles", "sign"), "cls")
    h = F.xxhash64("cls", "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = rows.select("*", every("blocks").alias("block"), F.pmod(h, F.col("stretches")).cast("int").alias("stretch"), F.lit(False).alias("proposes"))
    asking = rows.where("comp != main").select(
        "*", F.pmod(F.shiftright(h, 20), F.col("blocks")).cast("int").alias("block"), every("stretches").alias("stretch"), F.lit(True).alias("proposes"))
    cols = [*_GROUP, "n_shingles", "sign"]
    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    together = lambda df: df.repartition(n, "bucket", "stretch", "block").sortWithinPartitions("bucket", "stretch", "block")
    involved = stored(together(asked.select(cols).union(asking.select(cols))).mapInArrow(_involved(threshold, miss), _GROUP_SCHEMA), "involved")
    texts = _texts(involved.select("cls"), classes, docs)
    return together(involved.join(texts, "cls").select(*_GROUP, "text", "digest")).mapInArrow(
        _join_components(words, threshold, miss), "a bigint, b bigint").distinct()


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, text, digest) of the classes named in ``wanted``."""
    need = stored(wanted.distinct().join(classes.select("cls", "doc_id", "digest"), "cls"), "need")
    ids = F.broadcast(need) if need.count() <= SEND_IDS else need
    return stored(docs.join(ids, "doc_id").select("cls", "text", "digest"), "texts")


def _verify(words: int, threshold):
    """Exact links between a leader and the rows after it, in streams sorted by (a, stretch, leader first)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead = None, None
        for b in batches:
            out = []
            for a, stretch, cls, text, digest in zip(*(b.column(c).to_pylist() for c in ("a", "stretch", "b", "text", "digest")), strict=True):
                s = shingles(text, words)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != digest:
                    continue  # another text under the same id
                if cls is None:
                    key, lead = (a, stretch), s
                elif key == (a, stretch) and linked(len(np.intersect1d(lead, s, assume_unique=True)), len(lead), len(s), threshold):
                    out.append((a, cls))
            if out:
                yield _pairs(out)
    return run


def _exact(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, threshold) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold; each text is sent once for each pair, a leader's once a stretch."""
    spark = pairs.sparkSession
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("cls")), classes, docs)
    sized = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    leads = sized.select("a", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / LEADER_ROWS).cast("int"))).alias("stretch"))
    stretches = (F.floor(F.col("n") / LEADER_ROWS) + 1).cast("int")
    cut = pairs.join(sized, "a").select("a", "b", F.pmod(F.xxhash64("b"), stretches).cast("int").alias("stretch"))
    first = leads.join(texts.withColumnRenamed("cls", "a"), "a").select("a", "stretch", F.lit(None).cast("bigint").alias("b"), "text", "digest")
    rest = cut.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "stretch", "b", "text", "digest")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = first.union(rest).repartition(parts, "a", "stretch").sortWithinPartitions("a", "stretch", F.col("b").asc_nulls_first())
    return rows.mapInArrow(lean(_verify(words, threshold)), "a bigint, b bigint").distinct()


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("cls"), F.col("component").alias("comp"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                    threshold: tuple[int, int] = THRESHOLD, miss: float = MISS) -> DataFrame:
    """doc_id, version, n_shingles, group, component_id and kept for every row; ``threshold`` is a fraction.

    ``version`` is a hash of the text, for rows that share an id but not a text. ``group`` numbers the components, also those whose smallest
    ids are the same; it is null without shingles.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(docs.mapInArrow(lean(_sign(words)), f"doc_id {kind}, version bigint, n_shingles bigint, digest binary, sign binary"), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sign").alias("sign"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sign", i * ROWS * 4 + 1, ROWS * 4)) for i in range(BANDS)])
    banded = classes.select("cls", F.posexplode(bands).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("cls").alias("lead"), F.max("cls").alias("last")).where("lead < last").drop("last")
    members = stored(banded.join(shared, "bucket"), "members")

    pairs = stored(_star_pairs(members, classes, threshold, miss), "pairs")
    links = stored(_exact(pairs, classes, docs, words, threshold), "links")
    found = _named(components(links))
    links = links.unionByName(stored(_across(members, found, classes, docs, words, threshold, miss), "links"))
    comps = _named(components(links))

    named = classes.select("digest", "cls", "doc_id").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    roots = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_digest = named.join(roots, "comp").select("digest", F.col("comp").alias("group"), "component_id")
    out = signed.select("doc_id", "version", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("digest")).alias("digest"))
    return out.join(by_digest, "digest", "left").select(
        "doc_id", "version", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: its smallest id, of that id's texts the one with the smallest hash.

    Rows that share an id are documents of their own where their texts differ. Rows that repeat an id and a text are one, with the smallest of their
    other columns. Documents without shingles are in no group and stay; so do all rows without an id.
    """
    found = near_duplicates(docs, doc_id, text, words, threshold).where("kept").select("doc_id", "version", "group")
    grouped = found.where("group is not null").groupBy("group", "doc_id").agg(F.min("version").alias("version")).select("doc_id", "version")
    stays = grouped.union(found.where("group is null").select("doc_id", "version").distinct()).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
    rest = [c for c in docs.columns if c != doc_id]
    named = docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_version")).agg(F.min(F.struct(*rest)).alias("_row"))
    kept = named.join(stays, ["_id", "_version"], "left_semi").select(F.col("_id").alias(doc_id), "_row.*").select(*docs.columns)
    return kept.unionByName(docs.where(F.col(doc_id).isNull()))


def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near-duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=QUERY_WORDS).drop("version", "group")


QUERIES = {"op3_bayes_minhash": Query(near_duplicate_documents)}
