"""Written intermediates, distributed numbering and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledgerlens.session import work_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{work_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`stored` once what was made of it is written; nothing that is read later may depend on it."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/llm/" in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, giving freed memory back to the system before and after: a worker outlives its task and keeps it otherwise."""

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would also change other alphabets."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, group: list[str], order: list[Column], bucket: Column, out: str) -> DataFrame:
    """Number the rows of every group gaplessly from 0, ordered by ``bucket`` and then ``order``.

    A group is cut by the integer ``bucket`` (a hash of the row, a few dozen values), so the
    window sorts one bucket of a group at a time and a hot group has no task of its own. The
    bucket sizes, one row for each group and bucket, give each bucket its offset. ``df``
    is read twice and must give the same rows both times.
    """
    cut = df.withColumn("_bucket", bucket.cast("int"))
    sizes = cut.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_bucket").alias("_of"), before.alias("_before"))
    rank = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*order)) - 1
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("_bucket") == F.col("_of")]
    return (
        cut.withColumn("_rank", rank).join(offsets, same)
        .withColumn(out, F.col("_before") + F.col("_rank"))
        .drop("_bucket", "_rank", "_of", "_before", *[f"_{g}" for g in group])
    )


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of a graph given by index pairs."""
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[:len(left)], flat[len(left):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by stars, batch by batch: never more edges than nodes."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a, b = forest(np.concatenate([a, batch.column("u").to_numpy()]), np.concatenate([b, batch.column("v").to_numpy()]))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b: bigint): the smallest id it is connected with.

    Each partition first folds its own edges into stars. Alternating large-star and small-star
    rounds then hook the neighbours of every node to the smallest one it knows, until no edge changes.
    Groups keep a minimum only, so no neighbourhood is gathered; each round is a written table.
    """
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = stored(ends.mapInArrow(_forests, "u bigint, v bigint"), name)
    mark = _mark(pairs)
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        large = large.where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x != y")
        small = hooked.union(low.select("u", "m")).select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
        pairs = stored(small, name)
        before, mark = mark, _mark(pairs)
        if before == mark:
            roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _mark(pairs: DataFrame):
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
