"""Tables in buckets of documents: later steps shuffle nothing, and the shuffles that made a table go with its write."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import frames
from ledgerlens.plans import QUERIES
from tests.test_plans import plan


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# corrections are shuffled, a few rows
@pytest.mark.parametrize("name, most", [("extracted_results", 0), ("reviewed_results", 0), ("results", 0), ("export_json_metadata", 0), ("export_json", 2), ("line_item_boxes", 0)])
def test_fields_and_items_are_not_shuffled_again(spark, sf_dir, no_broadcast, name, most):
    assert plan(QUERIES[name].run(spark, sf_dir)).count("Exchange hashpartitioning") <= most


def test_written_rows_come_back(spark, no_broadcast):
    rows = [(None, "a"), (None, None), *[(i % 7, f"t{i}") for i in range(50)], (3, "t3")]
    made = spark.createDataFrame(rows, "document_id long, text string")
    table = frames.written(frames.spread(made, "document_id"), "rows")
    assert sorted(map(tuple, table.collect()), key=repr) == sorted(rows, key=repr)
    assert table.columns == ["document_id", "text"]
    assert "Exchange" not in plan(table.groupBy("document_id").agg(F.count(F.lit(1))))
    empty = frames.written(made.limit(0), "rows")
    assert empty.count() == 0 and empty.columns == made.columns


def test_shuffles_go_with_the_write(spark):
    def held():
        env = spark._jvm.org.apache.spark.SparkEnv.get()
        folders = [f.getPath() for f in env.blockManager().diskBlockManager().localDirs()]
        return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before = held()
    rows = spark.range(20000).select((F.col("id") % 500).alias("document_id"), F.col("id").cast("string").alias("text"))
    for write in (frames.stored, frames.written):
        assert write(frames.spread(rows, "document_id"), "freed").count() == 20000
    left = held() - before
    # only counts of a few bytes stay
    assert sum(os.path.getsize(os.path.join(d, f)) for top in [x.getPath() for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
               for d, _, names in os.walk(top) for f in names if f in left) < 5000


def test_settings_of_a_write_end_with_it(spark):
    before = {n: spark.conf.get(n, None) for n in frames._SETTINGS.values()}
    frames.written_in_place(spark.range(3).withColumnRenamed("id", "document_id"), "few")
    with pytest.raises(Exception):
        frames.written(spark.range(1), "without_documents")
    assert {n: spark.conf.get(n, None) for n in frames._SETTINGS.values()} == before


def test_maintained_results_shuffle_nothing_first_and_read_a_batch_once(spark, tmp_path, no_broadcast):
    from ledgerlens.streaming import maintained as MT

    fields = spark.createDataFrame([(d, f, f"{f}{d}", 0.5, "local", False) for d in range(40) for f in ("po_number", "vendor.name")],
                                   "document_id long, field_path string, value string, confidence double, source_model string, flagged boolean")
    items = spark.createDataFrame([(d, 0, "thing") for d in range(40)], "document_id long, pos int, description string")
    fields, items = (frames.written(frames.spread(df, "document_id"), n) for df, n in ((fields, "fields"), (items, "items")))
    plans, files = [], []

    def compute(fields, items):
        out = fields.groupBy("document_id").agg(F.max("value").alias("v")).join(items.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")), "document_id")
        plans.append(plan(out))
        files.append(items.inputFiles())
        return out

    folder = str(tmp_path / "m")
    MT.prepare(fields, items, compute, folder)
    assert "Exchange" not in plans[0]
    schema = "document_id long, field_path string, corrected_value string, reviewer_id string, seq long"
    spark.createDataFrame([(3, "po_number", "zz", "r", 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    MT.maintain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), compute, folder)
    assert len(files) == 2 and files[1] and not [f for f in files[1] if f"{folder}/items" in f]
    assert sorted((r["document_id"], r["v"]) for r in MT.current_results(spark, folder).filter("document_id in (3, 4)").collect()) == [(3, "zz"), (4, "vendor.name4")]
    assert [(r["n_buckets"], r["n_documents"]) for r in MT.touched(spark, folder).collect()] == [(1, 1)]
