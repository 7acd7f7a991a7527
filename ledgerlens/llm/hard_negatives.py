"""Hard negatives for anchors, by exact integer scores from a residue number system.

Components become whole numbers. An anchor block and a batch of rows are multiplied modulo several small primes: residues are
centred, so a product of matrices in float32 is exact (dimensions are cut where a sum could pass 2**24), and the signed score
comes back by Chinese remaindering. The number of primes follows from the largest components of the two sides. Selection by window:

1. An anchor's positives are the best ``positives`` other rows of its label. Only rows of the same label meet.
2. Each positive opens a window of scores, ``low`` to ``high`` hundredths of its own. The best ``negatives`` rows of other labels
   inside it are its negatives.

Anchors are cut into blocks of about ``ANCHORS`` and rows into batches of about ``ROWS``; a task streams one batch past one block and
keeps the best rows of each anchor, so neither a common label nor a common vector grows a task. Batches are joined by a ranking
of a few rows for each anchor and batch. Every anchor is scored against every row: the work is anchors times rows, and a row is sent once for each anchor block.

Rows with a null id, label or vector or with a null or non-finite component take no part. Rows of another dimension than an anchor's
are not scored against it; empty vectors score 0. Ties go to the smaller id. Rows that repeat an id: anchors repeated whole count once,
others each; as a candidate every row counts, but none with the anchor's own id. Scores beyond 62 bits are held at that bound, in order and output.
Without rows, anchors, positives or rows in a window the result is empty. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledgerlens.llm.common import stored, table
from ledgerlens.plans.registry import Query

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Anchors of a block, rows of a batch, scores in memory at once.
ANCHORS, ROWS, TILE = 2048, 32768, 1 << 21
#: Primes are below this; centred residues then stay within 127.
PRIME_LIMIT = 256
LOWEST, HIGHEST = -(1 << 62), 1 << 62
#: No float32 reaches this once scaled; larger components of doubles are held here.
COMPONENT = 2.0**140


def primes(limit: int = PRIME_LIMIT) -> list[int]:
    """Odd primes below ``limit``, the largest first."""
    return [p for p in range(limit - 1, 2, -1) if all(p % d for d in range(2, int(p**0.5) + 1))]


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) in doubles; multiplying by a power of two and flooring are exact."""
    return np.clip(np.floor(scale * x.astype(np.float64)), -COMPONENT, COMPONENT)


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    return x - p * np.rint(x / p)


class Moduli:
    """Primes enough for inner products of ``dim`` components up to ``a`` and ``b`` in size, and how to put residues together."""

    def __init__(self, dim: int, a: int, b: int):
        need, self.primes, self.product = 4 * dim * a * b + 1, [], 1
        for p in primes():
            if self.product > need and self.primes:
                break
            self.primes.append(p)
            self.product *= p
        if self.product <= need:
            raise ValueError(f"inner products of {dim} components of this size pass the primes below {PRIME_LIMIT}")
        self.parts = [self.product // p for p in self.primes]
        self.inverse = [pow(part, -1, p) for p, part in zip(self.primes, self.parts, strict=True)]
        self.fits = self.product * len(self.primes) < 1 << 52
        self.depth = max(1, (1 << 24) // (PRIME_LIMIT // 2) ** 2)  # dimensions whose products sum exactly in float32

    def residues(self, q: np.ndarray) -> list[np.ndarray]:
        return [_centred(np.fmod(q, p), p).astype(np.float32) for p in self.primes]

    def scores(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """Exact inner products, rows of ``left`` by rows of ``right``, from their residues."""
        dim = left[0].shape[1]
        total = 0.0 if self.fits else 0
        for p, part, inverse, a, b in zip(self.primes, self.parts, self.inverse, left, right, strict=True):
            rest = np.zeros((len(a), len(b)), np.float32)
            for lo in range(0, dim, self.depth):
                rest = _centred(rest + _centred(a[:, lo:lo + self.depth] @ b[:, lo:lo + self.depth].T, np.float32(p)), np.float32(p))
            digit = _centred(rest * np.float32(inverse), np.float32(p))
            total = total + (digit.astype(np.float64) * float(part) if self.fits else digit.astype(np.int64).astype(object) * part)
        if self.fits:
            return (total - self.product * np.rint(total / self.product)).astype(np.int64)
        total = (total + self.product // 2) % self.product - self.product // 2
        return np.clip(total, LOWEST, HIGHEST).astype(np.int64)


class Best:
    """The best ``k`` (score, id) of each of ``groups``; ids arrive in rising order, so a tie with the last place loses."""

    def __init__(self, groups: int, k: int):
        self.k, self.score, self.id = k, np.full((groups, k), LOWEST - 1), np.zeros((groups, k), np.int64)

    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        touched, local = np.unique(at, return_inverse=True)
        group = np.concatenate([np.repeat(np.arange(len(touched)), self.k), local])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -score, group))
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        order = order[place < self.k]
        self.score[touched], self.id[touched] = score[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, place = np.nonzero(self.score >= LOWEST)
        return group, self.score[group, place], self.id[group, place]


def _vectors(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)


class _Block:
    """The anchors of a group; ``offer`` scores a batch of rows against them."""

    def __init__(self, anchors: list[pa.RecordBatch], dim: int, scale: int, k: int, windows: int):
        t = pa.Table.from_batches(anchors).combine_chunks().to_batches()[0]
        self.uid, self.own = t.column("uid").to_numpy(), t.column("vec_id").to_numpy()
        self.dim, self.scale, self.q = dim, scale, whole(_vectors(t, dim), scale)
        self.top = int(np.abs(self.q).max(initial=0.0))
        codes: dict = {}
        self.label = np.array([codes.setdefault(x, len(codes)) for x in t.column("label").to_pylist()])
        self.codes, self.seen, self.moduli = codes, 0, {}
        self.windows = max(1, windows)
        self.best = Best(len(self.uid) * self.windows, k)
        if windows:
            self.low, self.high = np.full((2, len(self.uid), windows), LOWEST)
            self.low += 1  # an empty window
            for i, opened in enumerate(t.column("windows").to_pylist()):
                for w in opened:
                    self.low[i, w["place"]], self.high[i, w["place"]] = w["low"], w["high"]

    def _scores(self, q: np.ndarray) -> np.ndarray:
        bits = int(np.abs(q).max(initial=0.0)).bit_length()
        if bits not in self.moduli:
            m = Moduli(max(self.dim, 1), max(self.top, 1), 1 << bits)
            self.moduli[bits] = m, m.residues(self.q)
        m, left = self.moduli[bits]
        return m.scores(left, m.residues(q))

    def offer(self, rows: pa.RecordBatch, select: Callable) -> None:
        most, lo = max(1, TILE // len(self.uid)), 0
        while lo < rows.num_rows:
            # short first tiles set the bar, so that later ones offer few candidates
            part = rows.slice(lo, min(most, max(16, self.seen)))
            ids, q = part.column("vec_id").to_numpy(), whole(_vectors(part, self.dim), self.scale)
            select(self, self._scores(q), ids, part)
            lo += part.num_rows
            self.seen += part.num_rows


def _same_label(block: _Block, score: np.ndarray, ids: np.ndarray, part: pa.RecordBatch) -> None:
    a, r = np.nonzero((score > block.best.score[:, -1:]) & (ids[None, :] != block.own[:, None]))
    block.best.offer(a, score[a, r], ids[r])


def _in_windows(block: _Block, score: np.ndarray, ids: np.ndarray, part: pa.RecordBatch) -> None:
    label = np.array([block.codes.get(x, -1) for x in part.column("label").to_pylist()])
    other = label[None, :] != block.label[:, None]
    worst = block.best.score[:, -1].reshape(len(block.uid), -1)
    for w in range(block.windows):
        floor = np.maximum(block.low[:, w], worst[:, w] + 1)[:, None]
        a, r = np.nonzero(other & (score >= floor) & (score <= block.high[:, w][:, None]))
        block.best.offer(a * block.windows + w, score[a, r], ids[r])


def _stream(select: Callable, scale: int, k: int, windows: int):
    """Partitions sorted by group, anchors first and rows by rising id: the best rows of each anchor, (uid, place, score, vec_id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            marks = [b.column(c) for c in ("grp", "block", "salt", "is_row")]
            turn = np.zeros(b.num_rows - 1, bool)
            for m in marks:
                turn |= pc.not_equal(m[1:], m[:-1]).to_numpy(zero_copy_only=False)
            for start, stop in pairwise([0, *(np.flatnonzero(turn) + 1).tolist(), b.num_rows]):
                part, (*mark, is_row) = b.slice(start, stop - start), [m[start].as_py() for m in marks]
                if mark != key:
                    if block is not None:
                        yield _found(block)
                    key, held, block = mark, [], None
                if not is_row:
                    held.append(part)
                elif held:
                    if block is None:
                        block = _Block(held, part.column("dim")[0].as_py(), scale, k, windows)
                    block.offer(part, select)
        if block is not None:
            yield _found(block)
    return run


def _found(block: _Block) -> pa.RecordBatch:
    group, score, ids = block.best.found()
    place = (group % block.windows).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(block.uid[group // block.windows]), pa.array(place), pa.array(score), pa.array(ids)], ["uid", "place", "score", "vec_id"])


_FOUND = "uid bigint, place int, score bigint, vec_id bigint"


def _pass(anchors: DataFrame, rows: DataFrame, grp: Column, task) -> DataFrame:
    """Every anchor against every row of its group: blocks of anchors by batches of rows."""
    anchors, rows = anchors.withColumn("grp", grp), rows.withColumn("grp", grp)
    blocks = anchors.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("blocks"))
    sizes = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("salts"))
    cuts = blocks.join(sizes, "grp")  # one row for each label or dimension
    asking = anchors.join(cuts, "grp").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("is_row", F.lit(False))
    held = rows.join(cuts, "grp").withColumn("salt", F.pmod(F.xxhash64("at"), F.col("salts")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("is_row", F.lit(True))
    both = asking.unionByName(held, allowMissingColumns=True).drop("blocks", "salts", "at")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = both.repartition(parts, "grp", "block", "salt").sortWithinPartitions("grp", "block", "salt", "is_row", "vec_id")
    return dealt.mapInArrow(task, _FOUND)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    best = W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores; ``anchor`` is a condition on the columns of ``vectors``."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"), anchor.alias("anchor"))
    rows = rows.where("vec_id is not null and label is not null").where(F.forall("embedding", number)).withColumn("dim", F.size("embedding"))
    asked = rows.where("anchor").select("vec_id", "label", "embedding", "dim").distinct()
    asked = stored(asked.withColumn("uid", F.monotonically_increasing_id()), "anchors")
    rows = rows.select("vec_id", "label", "embedding", "dim", F.monotonically_increasing_id().alias("at"))

    same = _pass(asked, rows, F.concat_ws(":", "dim", "label"), _stream(_same_label, scale, positives, 0))
    first = stored(_ranked(same, ["uid"], positives).select("uid", (F.col("rank") - 1).alias("place"), "score", F.col("vec_id").alias("positive_id")), "positives")
    hundredth = lambda n, up: (F.ceil if up else F.floor)(F.col("score").cast("decimal(20,0)") * n / F.lit(100).cast("decimal(3,0)")).cast("long")
    opened = first.groupBy("uid").agg(F.collect_list(F.struct("place", hundredth(low, True).alias("low"), hundredth(high, False).alias("high"))).alias("windows"))
    other = _pass(asked.join(opened, "uid"), rows, F.col("dim").cast("string"), _stream(_in_windows, scale, negatives, positives))
    chosen = _ranked(other, ["uid", "place"], negatives).select("uid", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.join(first, ["uid", "place"]).join(asked.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """The table with the label of every seventh id moved on by one."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding against all embeddings."""
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


ORACLE = f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor({SCALE} * x::double) as bigint)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES})
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank, vec_id as negative_id,
  cast(positive_score as bigint) as positive_score, cast(score as bigint) as negative_score
from p join s using (anchor_id) where not same and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= {NEGATIVES}
"""

QUERIES = {"op11_residue_negatives": Query(mined_negatives, ORACLE)}
