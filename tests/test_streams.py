"""Streams over several small files end where the batch operators do."""

from pyspark.sql import functions as F

from ledgerlens.operators import jobs as J, review as V
from ledgerlens.sources import files as S
from ledgerlens.streaming import streams as ST

ROWS = [(1, 1, 0, "pending"), (1, 2, 10, "processing"), (2, 3, 5, "pending"), (1, 5, 30, "complete"), (1, 4, 20, "processing"),
        (2, 6, 40, "processing"), (2, 7, 2000, "complete"), (3, 8, 2, "processing"), (3, 9, 1, "pending")]


def events(spark, rows=ROWS):
    return spark.createDataFrame([(j, s, t, st) for j, s, t, st in rows], "job_id long, seq long, sec long, status string").select(
        "job_id", "seq", F.timestamp_seconds(F.col("sec") + 1704067200).alias("ts"), "status")


def in_files(spark, tmp_path, frame, n=3):
    """Write the rows as ``n`` files so that a stream needs ``n`` batches."""
    for i in range(n):
        frame.filter(F.col("seq") % n == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = frame.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_job_state_any_order(spark, tmp_path):
    stream = in_files(spark, tmp_path, events(spark))
    table, _ = ST.run_available(ST.job_state(stream), "jobs", mode="update", folder=str(tmp_path / "out"))
    want = J.current_jobs(events(spark))
    assert rows(ST.read_back(spark, table, ["job_id"]).select(want.columns)) == rows(want)


def test_folded_jobs_any_order(spark, tmp_path):
    stream = in_files(spark, tmp_path, events(spark).repartition(3))
    table, _ = ST.fold_jobs(stream, folder=str(tmp_path / "out"))
    want = J.current_jobs(events(spark))
    assert rows(J.merge_jobs(ST.read_back(spark, table)).select(want.columns)) == rows(want)


def test_restart_processes_new_files_only(spark, tmp_path):
    frame = events(spark)
    stream = in_files(spark, tmp_path, frame)
    out = str(tmp_path / "out")
    ST.run_available(ST.dedupe_jobs(stream, ["seq"]), "d", folder=out)
    frame.filter("seq = 1").withColumn("seq", F.lit(100).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table, _ = ST.run_available(ST.dedupe_jobs(again, ["seq"]), "d", folder=out)
    assert sorted(r["seq"] for r in ST.read_back(spark, table).collect()) == [*range(1, 10), 100]


def test_dedupe_keeps_late_first_rows(spark, tmp_path):
    day = 86_400
    newest = [(1, 1, 30 * day, "complete"), (1, 2, 29 * day, "pending")]
    late = [(2, 3, 0, "pending"), (1, 2, 29 * day, "pending"), (2, 4, 5 * day, "complete")]
    again = [(2, 3, 0, "pending"), (3, 5, 1, "pending")]
    for part in (newest, late, again):
        events(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in"))
        table, _ = ST.fold_dedupe(stream, ["seq"], folder=str(tmp_path / "out"))
    got = ST.first_rows(ST.read_back(spark, table), ["seq"])
    assert rows(got) == rows(events(spark, sorted({*newest, *late, *again})))


def test_tracker(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in"))
    table, _ = ST.run_available(ST.track_jobs(stream), "t", folder=str(tmp_path / "out"), one_batch=True)
    got = ST.read_back(spark, table)
    late = [(r["job_id"], r["seq"]) for r in got.filter("error_message is not null").collect()]
    assert late == [(2, 6)] and got.filter("error_message is null").count() == len(ROWS)


def test_tracker_takes_text_ids(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    named = events(spark).withColumn("job_id", F.concat(F.lit("3f2b-"), F.col("job_id").cast("string")))
    named.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(named.schema).parquet(str(tmp_path / "in"))
    table, _ = ST.run_available(ST.track_jobs(stream), "t", folder=str(tmp_path / "out"), one_batch=True)
    got = ST.read_back(spark, table)
    assert {r["job_id"] for r in got.collect()} == {"3f2b-1", "3f2b-2", "3f2b-3"}
    assert got.filter("error_message is not null").count() == 1


def test_corrections(spark, tmp_path):
    fixes = spark.createDataFrame([(1, "a", f"v{i}", "r", i) for i in range(6)] + [(2, "b", "w", "r", 7)],
                                  "document_id long, field_path string, corrected_value string, reviewer_id string, seq long")
    stream = in_files(spark, tmp_path, fixes)
    table, _ = ST.upsert_corrections(stream, folder=str(tmp_path / "out"))
    fields = spark.createDataFrame([(1, "a", "x", 0.4)], "document_id long, field_path string, value string, confidence double")
    stored = spark.read.parquet(table).drop("batch")
    assert rows(V.apply_corrections(fields, stored)) == rows(V.apply_corrections(fields, fixes))
    assert V.apply_corrections(fields, stored).filter("document_id = 1").first()["value"] == "v5"
    # seq decides, not the batch in which a correction came
    newest = ST.read_back(spark, table, keys=["document_id", "field_path"], order=("seq",))
    assert {r["field_path"]: r["corrected_value"] for r in newest.collect()} == {"a": "v5", "b": "w"}


def test_landing_folder(spark, tmp_path):
    for name, body in {"d1/a.pdf": b"%PDF-1.7 x", "d2/b.png": b"\x89PNG\r\n\x1a\nzz", "d3/c.pdf": b"", "d4/e.webp": b"RIFF0000WAVEzz",
                       "d5/f.webp": b"RIFF0000WEBPzz", "d6/g.tif": b"MM\x00*zz"}.items():
        path = tmp_path / "land" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    files = ST.read_landing(spark, str(tmp_path / "land")).withColumn("declared_mime", F.lit("application/octet-stream"))
    table, _ = ST.run_available(ST.ingest(files), "in", folder=str(tmp_path / "out"))
    got = {r["document_id"]: (r["detected_type"], r["reject_reason"], r["job_status"]) for r in ST.read_back(spark, table).collect()}
    assert got == {
        "d1": ("application/pdf", None, "pending"), "d2": ("image/png", None, "pending"),
        "d4": (None, "content not recognised", "failed"), "d5": ("image/webp", None, "pending"), "d6": ("image/tiff", None, "pending")}
    batch = S.scan_documents(spark, str(tmp_path / "land"), "*.pdf")
    assert sorted(r["document_id"] for r in batch.collect()) == ["d1"]  # the source skips empty files
    empty = spark.createDataFrame([("a.pdf", "application/pdf", "", 0)], "filename string, declared_mime string, header_hex string, size_bytes long")
    assert S.admit_files(empty).first()["reject_reason"] == "empty"
    listing = S.scan_documents(spark, str(tmp_path / "land"), with_content=False)
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_mail(spark):
    parts = spark.createDataFrame([
        (1, "Order 7", "attachment", "a.pdf", "application/pdf", 10), (2, "hello", "attachment", "a.pdf", "application/pdf", 10),
        (3, "order", "inline", "a.pdf", "application/pdf", 10), (4, "ORDER", "attachment", None, "application/pdf", 10),
        (5, "order", "Attachment", "a.txt", "text/plain", 10), (6, "order", "attachment", "a.pdf", "application/pdf", 0),
        (7, "order", "attachment", "a.pdf", "application/pdf", 21 * 1024 * 1024), (8, "order", "attachment", "x", "multipart/mixed", 1)],
        "message_id int, subject string, disposition string, filename string, mime_type string, size_bytes long").withColumn("sender", F.lit(None).cast("string"))
    got = {r["message_id"]: r["reject_reason"] for r in S.admit_attachments(parts, "order").collect()}
    assert got == {1: None, 2: "subject does not match", 3: "not an attachment", 4: "no file name", 5: "type not allowed", 6: "empty", 7: "too large", 8: "container"}
    assert S.admit_attachments(parts).filter("message_id = 2").first()["reject_reason"] is None
    assert S.admit_attachments(parts).first()["sender"] == "unknown"


def test_results_follow_corrections(spark, tmp_path):
    """Only touched documents are computed anew; late corrections do not win over newer ones; unknown documents are rejected."""
    from ledgerlens.operators import assemble as A
    from ledgerlens.streaming import maintained as MT

    names = ["po_number", "vendor.name"]
    fields = spark.createDataFrame([(d, f, None if d == 7 else f"{f}{d}", 0.5, "local", f == "po_number") for d in range(40) for f in names],
                                   "document_id long, field_path string, value string, confidence double, source_model string, flagged boolean")
    items = spark.createDataFrame([(d, 0, "thing") for d in range(40)], "document_id long, pos int, description string")
    none = spark.createDataFrame([], "document_id long, rule_order int, rule string, severity string, message string, affected_fields array<string>")

    def compute(fields, items):
        out = A.assemble_results(fields, none, items)
        return out.select("document_id", "po_number", F.col("vendor.name").alias("vendor"), "overall_confidence", F.size("fields_flagged").alias("n"), "line_items")

    folder = str(tmp_path / "m")
    MT.prepare(fields, items, compute, folder)
    schema = "document_id long, field_path string, corrected_value string, reviewer_id string, seq long"
    batches = [[(3, "po_number", "new", "r", 5), (4, "vendor.name", "V", "r", 6), (99, "po_number", "x", "r", 7)],
               [(3, "po_number", "old", "r", 2), (7, "po_number", "read", "r", 8)], [(4, "po_number", "P", "r", 9), (4, "po_number", "Q", "r", 10)]]
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        MT.maintain(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), compute, folder)
    got = MT.current_results(spark, folder)
    fixes = spark.createDataFrame([r for b in batches for r in b if r[0] != 99], schema)
    assert rows(got) == rows(compute(V.apply_corrections(fields, fixes), items))
    by_id = {r["document_id"]: r for r in got.collect()}
    assert (by_id[3]["po_number"], by_id[7]["po_number"], by_id[4]["po_number"], by_id[4]["overall_confidence"], len(by_id)) == ("new", "read", "Q", 1.0, 40)
    assert [(r["n_documents"], r["n_buckets"] <= 3) for r in MT.touched(spark, folder).orderBy("batch").collect()] == [(2, True), (2, True), (1, True)]
    assert [r["document_id"] for r in MT.rejected(spark, folder).collect()] == [99]


def in_event_time(spark, tmp_path, name, parts, **limits):
    """Run parts one after the other under one checkpoint; the last row moves the watermark past all others."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    end = [(-1, 10**6, 10 * 86_400, "pending")]
    for part in (*parts, end):
        events(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))
        stream = spark.readStream.schema(events(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}-in"))
        table, _ = ST.run_available(ST.track_jobs_in_event_time(stream, **limits), name, folder=str(tmp_path / f"{name}-out"))
    return ST.read_back(spark, table)


def test_event_time_tracker_is_the_same_in_every_replay(spark, tmp_path):
    """A job with a third of all events and many buckets, in two orders; the timeouts are those of the batch operator."""
    import random

    rnd = random.Random(4)
    made = [(rnd.choice([1, 1, 2, 3]), seq, rnd.randrange(30_000), rnd.choice(["pending", "processing", "complete"])) for seq in range(240)]
    by_time = sorted(made, key=lambda r: r[2])
    runs = [[by_time[:80], by_time[80:160], by_time[160:]], [sorted(made[i::2]) for i in range(2)]]
    got = [in_event_time(spark, tmp_path, f"e{i}", parts, late="10 hours") for i, parts in enumerate(runs)]
    assert rows(got[0]) == rows(got[1])
    late = J.job_timeouts(events(spark, made), "2024-02-01 00:00:00").select("job_id", "seq", "status", "error_message")
    assert rows(got[0].filter("error_message is not null")) == rows(late.select(got[0].columns)) and late.count() > 3
    assert rows(got[0].filter("error_message is null").select("job_id", "seq", "status")) == rows(events(spark, made).select("job_id", "seq", "status"))


def test_event_time_tracker_forgets_old_jobs(spark, tmp_path):
    """A job is forgotten 24 hours after its last event; one that never ends is reported once before that."""
    day = 86_400
    parts = [[(1, 1, 0, "processing"), (2, 2, 5, "complete")], [(3, 3, 2 * day, "pending")], [(1, 4, 3 * day, "complete"), (2, 5, 6, "pending")]]
    got = in_event_time(spark, tmp_path, "x", parts)
    assert sorted((r["job_id"], r["seq"], r["status"]) for r in got.collect()) == [
        (1, 1, "failed"), (1, 1, "processing"), (1, 4, "complete"), (2, 2, "complete"), (3, 3, "pending")]
    store = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "x-out" / "checkpoint"))
    assert 2 not in {r["key"][0] for r in store.collect()}


def test_event_time_tracker_asks_the_state_seldom():
    """Each look at the state is a round trip: one timer for a job, and its few waiting buckets are read and cleared together."""
    import pandas as pd

    asked, held, last = [], {}, []

    class Handle:
        def getValueState(self, *_):
            return self

        def getMapState(self, *_):
            return Waiting()

        def registerTimer(self, at):
            asked.append(("timer", at))

        def get(self):
            return last[-1] if last else None

        def exists(self):
            return bool(last)

        def update(self, row):
            last.append(row)

        def clear(self):
            last.clear()

    class Waiting:
        def keys(self):
            return iter(list(held))

        def iterator(self):
            asked.append(("all",))
            return iter(list(held.items()))

        def containsKey(self, key):
            asked.append(("has", key))
            return key in held

        def getValue(self, key):
            asked.append(("get", key))
            return held.get(key)

        def updateValue(self, key, value):
            held[key] = value

        def removeKey(self, key):
            asked.append(("remove", key))
            del held[key]

        def clear(self):
            asked.append(("clear",))
            held.clear()

    class Clock:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    tracker = ST.EventTimeTracker(600, 86_400, 600)
    tracker.init(Handle())
    batch = pd.DataFrame({"at_ms": [600_000 * i for i in range(50)], "seq": range(50), "status": ["pending"] * 50})
    assert list(f for f in tracker.handleInputRows((1,), iter([batch]), Clock(0)) if len(f)) == []
    assert asked == [("timer", 600_000)] and len(held) == 50
    asked.clear()
    (out,) = tracker.handleExpiredTimer((1,), Clock(600_000 * 40), None)
    assert out["seq"].tolist() == list(range(40)) and len(held) == 10
    assert ("all",) in asked and [a for a in asked if a[0] in ("get", "has")] == [] and asked[-1] == ("timer", 600_000 * 41)
    asked.clear()
    (out,) = tracker.handleExpiredTimer((1,), Clock(600_000 * 60), None)
    assert out["seq"].tolist() == list(range(40, 50)) and not held and ("clear",) in asked
    assert len([a for a in asked if a[0] == "timer"]) == 1


def test_tables_are_files_or_folders(spark, tmp_path):
    frame = events(spark).coalesce(1)
    frame.write.parquet(str(tmp_path / "made"))
    (file,) = (tmp_path / "made").glob("part-*.parquet")
    file.rename(tmp_path / "one.parquet")
    frame.repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    for pattern in ("one.parquet", "many.parquet"):
        table, _ = ST.run_available(ST.read_table(spark, str(tmp_path), pattern, 1), "t", folder=str(tmp_path / f"out-{pattern}"))
        assert rows(ST.read_back(spark, table).select(frame.columns)) == rows(frame)
