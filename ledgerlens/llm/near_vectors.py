"""Embedding near-duplicates by inverted lists and product quantisation.

1. Equal vectors are one class from here on, weighed by their number.
2. Coarse centroids and, on residuals, subspace codebooks are fitted on a bounded sample. Every class is indexed in the
   list of its nearest centroid, with the codes of its residual and the length of its quantisation error.
3. Every class is a query against its ``probes`` nearest lists. Distances to a list's codes come from a table
   of query-to-codeword distances. By the triangle inequality a vector within the threshold
   distance has a table distance of at most that distance plus its quantisation error, so this step loses nothing.
4. What is left is reranked by the exact cosine in double precision.

Pairs are never written: a task returns, for each batch, how many rows each class is linked with and a
spanning forest of the links, one row for each class at most. A list is cut into blocks of ``BLOCK`` classes and the queries of a
list stream past each block, so a hot list is many groups of bounded size.

Vectors that are null, zero or hold null or non-finite components link with nothing, and neither do vectors of
another dimension or with a null id. Repeated rows are copies that link with each other.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.common import components, forest, stored, table
from ledgerlens.plans.registry import Query

COSINE = 0.9
#: Rows of the fitting sample, lists looked at for each query, subspaces and codewords of each.
SAMPLE, PROBES, SUBSPACES, CODEWORDS = 20_000, 16, 8, 64
MAX_LISTS = 4096
BLOCK, BATCH = 4096, 1024


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (-2 * x @ centre.T + (centre**2).sum(1)).argmin(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centre))
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def _split(dim: int, parts: int) -> list[slice]:
    edges = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def fit(sample: np.ndarray, lists: int) -> dict:
    """Coarse centroids and codebooks from unit vectors; plain arrays."""
    centre = _kmeans(sample, lists, 12, 1)
    near = (-2 * sample @ centre.T + (centre**2).sum(1)).argmin(1)
    rest = sample - centre[near]
    books = [_kmeans(rest[:, s], CODEWORDS, 10, 2 + i) for i, s in enumerate(_split(sample.shape[1], SUBSPACES))]
    return {"centre": centre, "books": books}


def encode(model: dict, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probed lists (nearest first), codes in the nearest list, and lengths of the quantisation errors."""
    centre = model["centre"]
    far = -2 * x @ centre.T + (centre**2).sum(1)
    probes = min(probes, len(centre))
    order = np.argsort(far, 1, kind="stable")[:, :probes]
    rest = x - centre[order[:, 0]]
    parts = _split(x.shape[1], SUBSPACES)
    codes = np.stack([(-2 * rest[:, s] @ b.T + (b**2).sum(1)).argmin(1) for s, b in zip(parts, model["books"], strict=True)], 1)
    back = np.concatenate([b[codes[:, i]] for i, b in enumerate(model["books"])], 1)
    return order, codes.astype(np.uint8), np.linalg.norm(rest - back, axis=1)


def table_distances(model: dict, queries: np.ndarray, lst: int, codes: np.ndarray) -> np.ndarray:
    """Squared distances of queries to the coded vectors of a list, by table look-up."""
    rest = queries - model["centre"][lst]
    out = np.zeros((len(queries), len(codes)))
    for i, (s, book) in enumerate(zip(_split(queries.shape[1], SUBSPACES), model["books"], strict=True)):
        entry = (rest[:, s] ** 2).sum(1)[:, None] - 2 * rest[:, s] @ book.T + (book**2).sum(1)
        out += entry[:, codes[:, i]]
    return out


def _unit(column: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)
    return x


def _index(model, probes: int):
    """One row for the list that holds a class, and one for each list it asks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.array(b.column("embedding").to_pylist(), np.float64)
            unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
            order, codes, error = encode(m, unit, probes)
            n, p = order.shape
            at = np.repeat(np.arange(n), p)
            take = pa.array(at)
            names = ["list", "holds", "cls", "weight", "home", "unit", "codes", "error", "probes"]
            packed = pa.array([u.tobytes() for u in unit], pa.binary())
            probed = pa.array([o.astype("<i4").tobytes() for o in order], pa.binary())
            coded = pa.array([c.tobytes() for c in codes], pa.binary())
            home = pa.array(order[:, 0].astype(np.int32))
            ids, weight = b.column("cls"), b.column("weight")
            yield pa.RecordBatch.from_arrays([home, pa.array(np.ones(n, bool)), ids, weight, home, packed, coded, pa.array(error), probed], names)
            none = pa.nulls(n * p, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(order.ravel().astype(np.int32)), pa.array(np.zeros(n * p, bool)), ids.take(take), weight.take(take), home.take(take),
                 packed.take(take), none, pa.nulls(n * p, pa.float64()), none], names)
    return run


_INDEX = "list int, holds boolean, cls bigint, weight bigint, home int, unit binary, codes binary, error double, probes binary"


def _search(model, cosine: float):
    """Streams sorted by (list, block), the block's classes first: counts of links and a forest of them."""
    reach = np.sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        key, held, ready = None, [], None
        for whole in batches:
            counts: dict[int, int] = {}
            edges: list[tuple[np.ndarray, np.ndarray]] = []
            for lo in range(0, whole.num_rows, BATCH):
                b = whole.slice(lo, BATCH)
                groups = np.stack([b.column("list").to_numpy(), b.column("block").to_numpy()], 1)
                turns = [0, *(np.flatnonzero((groups[1:] != groups[:-1]).any(1)) + 1).tolist(), len(groups)]
                for start, stop in zip(turns, turns[1:], strict=False):
                    part = b.slice(start, stop - start)
                    if key != tuple(groups[start]):
                        key, held, ready = tuple(groups[start]), [], None
                    holds = part.column("holds").to_numpy(zero_copy_only=False)
                    if holds.any():
                        held.append(part.filter(pa.array(holds)))
                    if holds.all() or not held:
                        continue
                    if ready is None:
                        ready = _block(held)
                    _link(m, key[0], ready, part.filter(pa.array(~holds)), reach, cosine, counts, edges)
            yield _found(counts, edges)
    return run


def _block(held: list[pa.RecordBatch]) -> dict:
    t = pa.Table.from_batches(held)
    unit = _unit(t.column("unit").to_pylist())
    return {
        "cls": t.column("cls").to_numpy(), "weight": t.column("weight").to_numpy(), "unit": unit,
        "codes": np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(unit), -1),
        "error": t.column("error").to_numpy(), "probes": np.frombuffer(b"".join(t.column("probes").to_pylist()), "<i4").reshape(len(unit), -1),
    }


def _link(m: dict, lst: int, block: dict, asking: pa.RecordBatch, reach: float, cosine: float, counts: dict, edges: list) -> None:
    unit = _unit(asking.column("unit").to_pylist())
    cls, weight, home = (asking.column(c).to_numpy() for c in ("cls", "weight", "home"))
    near = table_distances(m, unit, lst, block["codes"])
    q, v = np.nonzero(near <= (reach + block["error"] + 1e-6)[None, :] ** 2)
    same = cls[q] == block["cls"][v]
    q, v = q[~same], v[~same]
    good = np.zeros(len(q), bool)
    for lo in range(0, len(q), 100_000):
        s = slice(lo, lo + 100_000)
        good[s] = np.einsum("ij,ij->i", unit[q[s]], block["unit"][v[s]]) >= cosine
    q, v = q[good], v[good]
    if not len(q):
        return
    # the class in the block asks as well; where it does not ask the list of this query, it would never count the link
    alone = ~(block["probes"][v] == home[q][:, None]).any(1)
    for ids, n in ((cls[q], block["weight"][v]), (block["cls"][v][alone], weight[q][alone])):
        nodes, at = np.unique(ids, return_inverse=True)
        for node, total in zip(nodes.tolist(), np.bincount(at, n).tolist() if len(at) else [], strict=True):
            counts[node] = counts.get(node, 0) + int(total)
    edges.append(forest(cls[q], block["cls"][v]))


def _found(counts: dict, edges: list) -> pa.RecordBatch:
    """Rows (cls, links, root): counts of links, then edges without counts."""
    a = np.concatenate([e[0] for e in edges]) if edges else np.empty(0, np.int64)
    b = np.concatenate([e[1] for e in edges]) if edges else np.empty(0, np.int64)
    if len(a):
        a, b = forest(a, b)
    return pa.RecordBatch.from_arrays([
        pa.array([*counts, *a.tolist()], pa.int64()), pa.array([*counts.values(), *[0] * len(a)], pa.int64()),
        pa.array([*counts, *b.tolist()], pa.int64())], ["cls", "links", "root"])


def linked_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
                   probes: int = PROBES, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    # a class is known by its vector; -0.0 is 0.0
    vector = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    classes = good.groupBy(vector.alias("embedding")).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "classes")

    dims = [r["dim"] for r in classes.groupBy("dim").count().orderBy(F.desc("count")).collect()]
    found = None
    for dim in dims:
        part = classes.where(F.col("dim") == dim)
        size = part.count()
        lists = int(min(MAX_LISTS, max(1, np.sqrt(size) / 2)))
        h = F.xxhash64("embedding")  # one vector for each of so many hash cells: the bounded fitting sample
        picked = part.groupBy(F.pmod(h, F.lit(sample))).agg(F.min_by("embedding", F.struct(h, "cls")).alias("embedding")).collect()
        x = np.array([r["embedding"] for r in picked], np.float64)
        model = spark.sparkContext.broadcast(fit(x / np.linalg.norm(x, axis=1, keepdims=True), lists))
        index = stored(part.select("cls", "weight", "embedding").mapInArrow(_index(model, probes), _INDEX), "index")
        sizes = index.where("holds").groupBy("list").count()  # one row for each list
        blocks = sizes.select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        cut = index.join(F.broadcast(blocks), "list")  # at most MAX_LISTS rows
        held = cut.where("holds").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        asking = cut.where("not holds").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        groups = held.unionByName(asking).drop("blocks").repartition(parts, "list", "block").sortWithinPartitions("list", "block", F.desc("holds"))
        links = groups.mapInArrow(_search(model, cosine), "cls bigint, links bigint, root bigint")
        found = links if found is None else found.unionByName(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stored(found, "links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = components(found.where("links = 0").select(F.col("cls").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("cls"), F.col("component").alias("comp"))
    named = classes.join(counts, "cls", "left").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    roots = named.groupBy("comp").agg(F.min("first").alias("component"))
    named = named.join(roots, "comp").select(
        F.col("embedding").alias("vector"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component")
    out = rows.select("vec_id", F.when(usable, vector).alias("vector")).join(named, "vector", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def linked_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's number of links and its component."""
    return linked_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_product_quantisation": Query(linked_embeddings)}
