"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.session import work_dir

CODEC = "zstd"
_SETTINGS = {
    "free": "spark.sql.classic.shuffleDependency.fileCleanup.enabled",
    "open_files": "spark.sql.maxConcurrentOutputFileWriters",
    "all_keys": "spark.sql.requireAllClusterKeysForCoPartition",
}


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def with_columns_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Add each missing column as a typed null, so an operator accepts partial input."""
    missing = {n: F.lit(None).cast(t) for n, t in names.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by ``keys`` over all shuffle partitions, whatever their bytes.

    For steps whose cost the bytes do not tell (scoring, parsing): a source of one file, or a
    small table, would otherwise be one busy task. A stated number is not merged again by AQE.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def _set(spark: SparkSession, **values: str):
    """Settings that hold for one write."""
    names = {_SETTINGS[k]: v for k, v in values.items()}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _path(df: DataFrame, name: str) -> tuple[str, str]:
    unique = f"{name}_{uuid.uuid4().hex}"
    return unique, f"{work_dir(df.sparkSession)}/{unique}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared work folder, for rows that several steps read: their joins and shuffles run once.

    What was shuffled to make it goes with the write, so a query holds the shuffles of one step at a time.
    """
    _, path = _path(df, name)
    with _set(df.sparkSession, free="true"):
        df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """:func:`stored`, in buckets of documents: joins and groups by document read the table without a shuffle.

    For rows that lie together by document already (see :func:`spread`), as each task writes a file for each bucket it holds.
    There are as many buckets as shuffle partitions. Files of several buckets are open at once, so nothing is sorted for the write.
    """
    spark = df.sparkSession
    unique, path = _path(df, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _set(spark, free="true", open_files=str(buckets)):
        df.write.option("compression", CODEC).option("path", path).bucketBy(buckets, "document_id").saveAsTable(f"ledgerlens_{unique}")
    return spark.table(f"ledgerlens_{unique}")


def written_in_place(df: DataFrame, name: str) -> DataFrame:
    """:func:`written`, where tables that are dealt out by a part of their common keys are joined as they lie.

    For rows made from one row for each document: dealt out before they were made, they meet by document and field
    without crossing the network again. Spark asks for all keys by default, as a part of them may be too few;
    a document's fields are a few dozen.
    """
    with _set(df.sparkSession, all_keys="false"):
        return written(df, name)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last-write-wins row per key.

    ``max_by`` over the whole row combines map-side, so a key holding a large
    share of the rows reaches the reducer as one row per map task; a
    ``row_number`` window would sort all of it in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)
