"""Results kept up to date from a stream of corrections.

A batch of corrections touches few documents. Their field rows and items are read from tables cut into
``BUCKETS`` by document, so only the buckets of touched documents are opened; score, flags and record of these
documents are computed anew and appended as the batch's part of the result table. The newest part that
holds a document is its result. Every batch owns its folders and overwrites them, so a batch that is run again after a failure leaves the same rows.

Corrections are kept by batch as well: a document's result takes the newest correction of each field over all batches so far,
in whatever order they came. Corrections of unknown documents go to ``rejected``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ledgerlens.operators import review as V
from ledgerlens.operators.frames import latest, stored
from ledgerlens.streaming.streams import read_back

BUCKETS = 64
CORRECTION = "document_id, field_path, corrected_value, reviewer_id, seq"

#: results of field rows and item rows; must have a row ``document_id`` for each document of the fields
Compute = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_of(document_id: Column) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(BUCKETS)).cast("int")


def prepare(fields: DataFrame, items: DataFrame, compute: Compute, folder: str) -> None:
    """Write the tables that batches read, and the results without corrections as batch -1.

    Both inputs are read twice, so they should be tables; those of ``frames.written`` give their results without a shuffle.
    """
    for name, rows in (("fields", fields), ("items", items)):
        cut = rows.withColumn("bucket", bucket_of(F.col("document_id")))
        cut.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")
    compute(fields, items).write.mode("overwrite").parquet(f"{folder}/results/batch=-1")


def maintain(corrections: DataFrame, compute: Compute, folder: str) -> None:
    """Apply what is there of a stream of corrections to the tables of :func:`prepare`, and stop."""

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest(batch.select(*CORRECTION.split(", ")), V.KEYS, ["seq"]).write.mode("overwrite").parquet(f"{folder}/corrections/batch={batch_id}")
        new = spark.read.parquet(f"{folder}/corrections/batch={batch_id}")
        touched = new.select("document_id").distinct().withColumn("bucket", bucket_of(F.col("document_id")))
        buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # BUCKETS at most

        def of_touched(name: str) -> DataFrame:
            # the few rows of a batch, which several steps read: the buckets are looked through once
            rows = spark.read.parquet(f"{folder}/{name}").filter(F.col("bucket").isin(buckets))
            return stored(rows.join(touched, ["bucket", "document_id"], "left_semi").drop("bucket"), f"touched_{name}")

        made = Observation()
        fields = of_touched("fields")
        known = fields.select("document_id").distinct()
        so_far = spark.read.parquet(f"{folder}/corrections").filter(F.col("batch") <= batch_id).drop("batch")
        fixed = V.apply_corrections(fields, so_far.join(known, "document_id", "left_semi"))
        out = compute(fixed, of_touched("items")).observe(made, F.count(F.lit(1)).alias("n_documents"))
        out.write.mode("overwrite").parquet(f"{folder}/results/batch={batch_id}")
        new.join(spark.read.parquet(f"{folder}/results/batch=-1").select("document_id"), "document_id", "left_anti").write.mode(
            "overwrite").parquet(f"{folder}/rejected/batch={batch_id}")
        counted = spark.range(1).select(F.lit(len(buckets)).cast("int").alias("n_buckets"), F.lit(made.get["n_documents"]).cast("long").alias("n_documents"))
        counted.write.mode("overwrite").parquet(f"{folder}/touched/batch={batch_id}")

    (corrections.writeStream.foreachBatch(update).option("checkpointLocation", f"{folder}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def current_results(spark: SparkSession, folder: str) -> DataFrame:
    """The newest result of every document."""
    return read_back(spark, f"{folder}/results", keys=["document_id"])


def touched(spark: SparkSession, folder: str) -> DataFrame:
    """Batch, buckets opened and documents computed anew."""
    return spark.read.parquet(f"{folder}/touched")


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections of documents without a result."""
    return spark.read.parquet(f"{folder}/rejected").drop("batch")
