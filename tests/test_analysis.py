"""Analyses against plain loops: sketches within their bounds, repeated rows, one pass for counters, states of a moment."""

import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.operators import analysis as Y
from ledgerlens.streaming import streams as ST


def test_sketches_of_days_merge_within_the_bound(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), day, rnd.choice([rnd.expovariate(0.01), 5.0]), rnd.randrange(4000)) for day in range(10) for _ in range(2000)]
    calls = spark.createDataFrame(rows, "provider string, day int, latency double, who int")
    days = Y.daily_sketches(calls, ["provider"], "latency", "who")
    assert days.count() == 20 and max(r["size"] for r in days.select(F.length("quantiles").alias("size")).collect()) < 20_000
    for r in Y.merged_sketches(days, ["provider"], (0.1, 0.5, 0.9, 0.99)).collect():
        mine = sorted(v for p, _, v, _ in rows if p == r["provider"])
        people = len({w for p, _, _, w in rows if p == r["provider"]})
        assert r["n"] == len(mine) and abs(r["n_distinct"] - people) <= 0.03 * people
        for rank, estimate in zip((0.1, 0.5, 0.9, 0.99), r["estimates"], strict=True):
            below, upto = (sum(v < estimate for v in mine) / len(mine), sum(v <= estimate for v in mine) / len(mine))
            assert below <= rank + 0.01 and upto >= rank - 0.01


def test_sketches_skip_nulls(spark):
    calls = spark.createDataFrame([("a", 1, None, None), ("a", 2, 3.0, 1)], "provider string, day int, latency double, who int")
    (r,) = Y.merged_sketches(Y.daily_sketches(calls, ["provider"], "latency", "who"), ["provider"], (0.5,)).collect()
    assert (r["n"], r["estimates"], r["n_distinct"]) == (1, [3.0], 1)


def test_cube_keeps_null_values_and_totals_apart(spark):
    flags = spark.createDataFrame([(1, "r", None), (2, "r", "FR"), (2, "s", "FR")], "document_id int, rule string, country string")
    got = {(r["rule"], r["country"], r["level"]): (r["n_flags"], r["n_documents"]) for r in Y.flag_cube(flags, ["rule", "country"]).collect()}
    assert got == {("r", None, 0): (1, 1), ("r", "FR", 0): (1, 1), ("s", "FR", 0): (1, 1), ("r", None, 1): (2, 2), ("s", None, 1): (1, 1),
                   (None, None, 2): (1, 1), (None, "FR", 2): (2, 1), (None, None, 3): (3, 2)}


def test_bag_changes_count_copies(spark):
    rnd = random.Random(1)
    make = lambda: [(rnd.choice([1, 2, 3, None]), rnd.choice(["x", "y", None])) for _ in range(60)]
    old, new = make(), make() + [(9, "z")] * 3
    frames = [spark.createDataFrame(r, "id int, v string") for r in (old, new)]
    got = Y.bag_changes(*frames, ["id"]).collect()
    a, b = Counter(old), Counter(new)
    assert {(r["id"], r["v"]): (r["n_removed"], r["n_added"]) for r in got} == {
        k: (max(a[k] - b[k], 0), max(b[k] - a[k], 0)) for k in a | b if a[k] != b[k]}
    lost, came = {k[0] for k in a if a[k] > b[k]}, {k[0] for k in b if b[k] > a[k]}
    assert all(r["change"] == ("changed" if r["id"] in lost & came else "removed" if r["n_removed"] else "added") for r in got)
    assert Counter(map(tuple, Y.unchanged(*frames).collect())) == a & b
    assert [r for r in Y.bag_changes(frames[0], frames[0], ["id"]).collect()] == []


def test_counters_need_no_second_pass(spark, tmp_path):
    rows, seen = Y.counted(spark.range(100).withColumn("v", F.expr("if(id % 4 = 0, null, id)")), "c", missing=F.col("v").isNull(), large=F.col("v") > 90)
    assert str(rows._jdf.queryExecution().executedPlan()).count("Range (") == 1
    rows.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 100, "missing": 25, "large": 7}


def test_counters_of_a_stream(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []

    def write(batch, _):
        rows, seen = Y.counted(batch, f"b{len(got)}", odd=F.col("id") % 2 == 1)
        rows.write.format("noop").mode("overwrite").save()
        got.append(seen.get)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(got) >= 2 and sum(g["rows"] for g in got) == 30 and sum(g["odd"] for g in got) == 15


def test_state_of_a_moment(spark):
    rnd = random.Random(6)
    history = [(rnd.choice([1, 1, 2]), rnd.randrange(0, 500_000, 5000), seq, f"v{seq}") for seq in range(120)] + [(3, 100, 500, "only")]
    moments = [(d, t) for d in (1, 2, 3, 4) for t in (-5, 0, 99, 100, 5000, 250_000, 250_001, 499_999, 10**7)]
    versions = Y.validity(spark.createDataFrame(history, "document_id int, sec long, seq int, value string").select(
        "document_id", F.timestamp_seconds("sec").alias("ts"), "seq", "value"), ["document_id"], bucket_seconds=40_000)
    assert versions.filter("valid_to is null").count() == 3
    asked = spark.createDataFrame(moments, "document_id int, sec long").select("document_id", F.timestamp_seconds("sec").alias("ts"), "sec")
    got = {(r["document_id"], r["sec"]): r["value"] for r in Y.as_of(asked, versions, ["document_id"], bucket_seconds=40_000).collect()}
    assert len(got) == len(moments)
    for d, t in moments:
        before = [(s, seq, v) for i, s, seq, v in history if i == d and s <= t]
        assert got[d, t] == (max(before)[2] if before else None), (d, t)


def test_windows_of_a_stream_with_late_rows(spark, tmp_path):
    """Rows within the watermark count in whatever batch they come; sessions that they join are one."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    schema = "provider string, sec long, ok boolean"
    parts = [[("p", 0, True), ("p", 1300, False), ("q", 50, True)], [("p", 500, True), ("p", 900, False)], [("p", 10**6, True)], [("q", 2 * 10**6, True)]]
    out = {}
    for name, op in (("s", Y.busy_phases), ("w", Y.sliding_failures)):
        for part in parts:
            rows = spark.createDataFrame(part, schema).select("provider", F.timestamp_seconds("sec").alias("ts"), "ok").coalesce(1)
            rows.write.mode("append").parquet(str(tmp_path / f"{name}-in"))
            stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / f"{name}-in")).withWatermark("ts", "1 hour")
            table, _ = ST.run_available(op(stream), name, folder=str(tmp_path / f"{name}-out"))
        every = spark.createDataFrame([r for p in parts[:3] for r in p], schema).select("provider", F.timestamp_seconds("sec").alias("ts"), "ok")
        out[name] = (sorted(map(str, ST.read_back(spark, table).collect())), sorted(map(str, op(every).collect())))
    assert out["s"][0] == out["s"][1] and out["w"][0] == out["w"][1] and len(out["s"][0]) == 3
