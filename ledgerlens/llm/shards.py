"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every level is one weighted draw: a child of weight ``w`` gets ``-ln(u) / w`` with ``u`` a
hash of (key, child), and the smallest wins, so a child wins in proportion to its weight.
A child's draw does not depend on its siblings. When weights below one child change, the
draws of that child and of its subtree change; keys leave or enter that child, and all
other subtrees trade nothing among themselves.

A shard that is added as a region of its own takes rows only into itself (law ``key``).
A shard that is added to a rack, or made heavier there, makes its rack and region heavier too: rows of other
regions may enter any shard of its region, rows of that region only its rack, and rows of the rack only the
shard itself. Nothing moves between the other subtrees.

Draws are digests, so the same placement can be computed anywhere. Null keys are drawn as
the text ``null``, all to one shard; null texts have no bytes; rows repeated whole are
separate rows with slots of their own; an empty table gives an empty one; further columns
are left alone by ``place`` (``region``, ``rack`` and ``shard`` are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.llm.common import numbered, stored, table
from ledgerlens.plans.registry import Query

#: Fixed shape of a grown tree: shards in a rack, racks in a region.
RACK_SHARDS, REGION_RACKS = 4, 2
#: A group's numbering is cut into so many pieces; a power of 16.
SLOT_BUCKETS = 256


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int) -> list[Shard]:
    """Shards filled rack by rack and region by region, each of weight 1."""
    per_region = RACK_SHARDS * REGION_RACKS
    return [Shard(s // per_region, s // RACK_SHARDS, s) for s in range(shards)]


def _draw(key: Column, child: str, weight: float) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"/{child}")).cast("binary"))
    share = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    return -F.log(share) / F.lit(float(weight))


def _lightest(key: Column, level: str, weights: dict[int, float]) -> Column:
    """Number of the winning child of one parent."""
    drawn = [
        F.struct(_draw(key, f"{level}{n}", w).alias("d"), F.lit(n).alias("n")) for n, w in weights.items() if w > 0
    ]
    return (drawn[0] if len(drawn) == 1 else F.least(*drawn))["n"]


def _sum(shards: list[Shard], level: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for s in shards:
        out[getattr(s, level)] = out.get(getattr(s, level), 0.0) + s.weight
    return out


def _descend(key: Column, parent: Column, shards: list[Shard], above: str, level: str) -> Column:
    """One level down: the children drawn are those of the parent that won above."""
    chosen = None
    for p in sorted({getattr(s, above) for s in shards}):
        below = [s for s in shards if getattr(s, above) == p]
        if sum(s.weight for s in below) <= 0:
            continue
        won = _lightest(key, level, _sum(below, level))
        chosen = F.when(parent == p, won) if chosen is None else chosen.when(parent == p, won)
    return chosen


def place(df: DataFrame, key: str, shards: list[Shard], prefix: str = "") -> DataFrame:
    """Add ``region``, ``rack`` and ``shard`` of every row (with ``prefix`` before the names)."""
    if not any(s.weight > 0 for s in shards):
        raise ValueError("a tree needs a shard of positive weight")
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    region, rack, shard = (prefix + n for n in ("region", "rack", "shard"))
    return (
        df.withColumn(region, _lightest(k, "region", _sum(shards, "region")))
        .withColumn(rack, _descend(k, F.col(region), shards, "region", "rack"))
        .withColumn(shard, _descend(k, F.col(rack), shards, "rack", "shard"))
    )


def slots(placed: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """Add ``slot``, the row's place in its shard, gapless from 0; ordered by digest head, key, ``ties``."""
    head = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), 1, 2), 16, 10)
    order = [F.col(c).asc_nulls_first() for c in [key, *ties]]
    return numbered(placed, ["shard"], order, head, "slot")


def write_shards(df: DataFrame, key: str, shards: list[Shard], path: str, files: int = 8) -> None:
    """Write every row below ``path/shard=N``, each shard in at most ``files`` files."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != key], F.col(key)), F.lit(files))
    placed = place(df, key, shards).withColumn("_salt", salt)
    placed.repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)


def sharded_documents(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """Every document with its shard among 24 and its shard when a 25th opens a region of its own."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = place(place(sized, "doc_id", tree(shards)), "doc_id", tree(shards + 1), "grown_")
    placed = stored(placed, "shards")
    return slots(placed, "doc_id", ["size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard",
        "region", "rack",
    )


QUERIES = {"op10_hash_tree_shards": Query(sharded_documents)}
