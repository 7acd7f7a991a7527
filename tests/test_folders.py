"""Message folders and named files as data sources."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import folders as FO
from ledgerlens.streaming import streams as ST

MAIL = b"From: a@x\r\nSubject: Order 7\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nhello\r\n" \
       b"--b\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=\"p.pdf\"\r\nContent-Transfer-Encoding: base64\r\n\r\nJVBERg==\r\n--b--\r\n"


def put(folder, name, body, at):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)
    os.utime(path, ns=(at, at))


def test_parts():
    got = list(FO.parts_of("m", MAIL))
    assert [(r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8]) for r in got] == [
        (0, "a@x", "Order 7", None, None, "text/plain", 5, b"hello"), (1, "a@x", "Order 7", "attachment", "p.pdf", "application/pdf", 4, b"%PDF")]
    assert [r[7] for r in FO.parts_of("e", b"")] == [0] and list(FO.parts_of("x", b"\xff\x00no message"))[0][2] is None


def test_reader_chooses_files_by_name(spark, tmp_path):
    for i, name in enumerate(["a/1.eml", "a/2.eml", "b/1.eml", "_temporary/x.eml", "b/.hidden"]):
        put(tmp_path / "in", name, MAIL, 10**18 + i)
    rows = FO.register(spark).read.format("message_folder").load(str(tmp_path / "in"))
    assert {r["name"] for r in rows.collect()} == {"a/1.eml", "a/2.eml", "b/1.eml"} and rows.count() == 6
    assert rows.filter(F.col("name").startswith("a/") & (F.col("part_no") == 1)).count() == 2
    reader = FO.MessageReader(str(tmp_path / "in"))
    left = list(reader.pushFilters([FO.StringStartsWith(("name",), "a/"), FO.EqualTo(("part_no",), 1)]))
    assert [f.attribute for f in left] == [("part_no",)] and reader.partitions()[0].names == ("a/1.eml", "a/2.eml")
    assert spark.read.format("message_folder").load(str(tmp_path / "none")).count() == 0


def test_stream_reads_each_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    FO.register(spark)
    seen = []
    for round_ in range(3):
        if round_ < 2:
            put(folder, f"{round_}.eml", MAIL, 10**18 + 5 - 0 * round_)  # equal times: the name decides
            put(folder, f"{round_}b.eml", MAIL, 10**18 + 6 + round_)
        stream = spark.readStream.format("message_folder").load(str(folder)).select("name", "part_no")
        table, _ = ST.run_available(stream, "m", folder=out)
        seen.append(sorted(r["name"] for r in spark.read.parquet(table).filter("part_no = 0").collect()))
    assert seen[0] == ["0.eml", "0b.eml"] and seen[1] == seen[2] == ["0.eml", "0b.eml", "1b.eml"]


def test_files_of_failed_and_repeated_tasks(tmp_path):
    """An attempt that fails half way, the one that follows, and a twin of it: one file for each row."""
    rows = [FO.Row(name=f"{i}/po.json", body=f"body {i}") for i in range(4)]
    writer = FO.NamedFileWriter(str(tmp_path / "out"))

    def broken():
        yield from rows[:2]
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(broken())
    done = writer.write(iter(rows))
    writer.write(iter(rows))
    writer.commit([done, None])
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert json.loads(found.pop("_SUCCESS")) == {"files": 4}
    assert found == {f"{i}/po.json": f"body {i}" for i in range(4)} and os.listdir(tmp_path / "out" / "_temporary") == []
    for name in (None, "", "../x", "a//b", "_x/y"):
        with pytest.raises(ValueError):
            writer.write(iter([FO.Row(name=name, body="")]))
    writer.abort([])


def test_named_files_round_trip(spark, tmp_path):
    FO.register(spark)
    rows = spark.createDataFrame([("r1/po_a.json", "é"), ("r2/po_b.json", None)], "name string, body string")
    for _ in range(2):
        rows.write.format("named_files").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out/r1/po_a.json").read_text() == "é" and (tmp_path / "out/r2/po_b.json").read_bytes() == b""
    assert len([p for p in (tmp_path / "out").rglob("*") if p.is_file()]) == 3
