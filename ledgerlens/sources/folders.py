"""Folders of messages and of named files as Spark data sources.

``message_folder`` reads MIME messages, in batch and as a stream; ``named_files`` writes one file for each row under the
row's own name. Files are reached through Arrow's file systems, from the tasks that read or write them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from email import message_from_bytes, policy

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, InputPartition, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import Row, StructType

FILES_PER_PARTITION = 200
MESSAGE = ("name string, part_no int, sender string, subject string, disposition string, filename string, mime_type string, size_bytes long, content binary")


def store(url: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or as a url."""
    if url.startswith("file:") and not url.startswith("file://"):
        url = "file://" + url[5:]
    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)


def listed(folder: str) -> list[tuple[int, str]]:
    """(modified in ns, name) of the files of a folder, oldest first; names that start with ``_`` or ``.`` are unfinished."""
    files, path = store(folder)
    found = files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    names = [(i.mtime_ns or 0, i.path[len(path.rstrip("/")) + 1:]) for i in found if i.is_file]
    return sorted((t, n) for t, n in names if not any(p.startswith(("_", ".")) for p in n.split("/")))


# --- messages ---------------------------------------------------------------------------------

@dataclass
class Names(InputPartition):
    names: tuple[str, ...]


def _partitions(names: list[str]) -> list[Names]:
    return [Names(tuple(names[i:i + FILES_PER_PARTITION])) for i in range(0, len(names), FILES_PER_PARTITION)] or [Names(())]


def parts_of(name: str, raw: bytes) -> Iterator[tuple]:
    """The leaf parts of a message; a file that is no message is one part without a sender."""
    message = message_from_bytes(raw, policy=policy.default)
    for n, part in enumerate(p for p in message.walk() if not p.is_multipart()):
        body = part.get_payload(decode=True) or b""
        yield (name, n, str(message["from"]) if message["from"] else None, str(message["subject"]) if message["subject"] else None,
               part.get_content_disposition(), part.get_filename(), part.get_content_type(), len(body), body)


def _read(folder: str, partition: Names) -> Iterator[tuple]:
    files, path = store(folder)
    for name in partition.names:
        with files.open_input_stream(f"{path.rstrip('/')}/{name}") as f:
            yield from parts_of(name, f.read())


class MessageReader(DataSourceReader):
    """Conditions on ``name`` choose files before any is opened."""

    def __init__(self, folder: str):
        self.folder, self.equal, self.prefix = folder, None, ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",) and self.equal is None:
                self.equal = f.value
            elif isinstance(f, StringStartsWith) and f.attribute == ("name",) and not self.prefix:
                self.prefix = f.value
            else:
                yield f

    def partitions(self) -> list[Names]:
        names = [n for _, n in listed(self.folder) if n.startswith(self.prefix) and self.equal in (None, n)]
        return _partitions(names)

    def read(self, partition: Names) -> Iterator[tuple]:
        return _read(self.folder, partition)


class MessageStream(DataSourceStreamReader):
    """Files in order of their times; an offset is the newest file read, so a restart reads none twice.

    A file must appear under its name with its final time (write it aside and rename it, as ``named_files`` does).
    """

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"at": 0, "name": ""}

    def latestOffset(self) -> dict:
        files = listed(self.folder)
        return {"at": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Names]:
        low, high = ((o["at"], o["name"]) for o in (start, end))
        return _partitions([n for t, n in listed(self.folder) if low < (t, n) <= high])

    def read(self, partition: Names) -> Iterator[tuple]:
        return _read(self.folder, partition)


class MessageFolder(DataSource):
    """``spark.read.format("message_folder").load(folder)``: a row for each part of each message."""

    @classmethod
    def name(cls) -> str:
        return "message_folder"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema: StructType) -> MessageReader:
        return MessageReader(self.options["path"])

    def streamReader(self, schema: StructType) -> MessageStream:
        return MessageStream(self.options["path"])


# --- named files --------------------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    files: int
    attempt: str


class NamedFileWriter(DataSourceWriter):
    """Each task writes its files aside and renames them one by one, so a reader never sees half a file.

    A task that fails and runs again, or runs twice, writes the same names with the same bytes: one file for each row remains. What an
    attempt left aside goes when the job ends, and ``_SUCCESS`` names the number of files.
    """

    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        files, path = store(self.folder)
        attempt = f"{path}/_temporary/{self.job}/{uuid.uuid4().hex}"
        files.create_dir(attempt)
        n, made = 0, set()
        for n, row in enumerate(rows, 1):
            parts = (row["name"] or "").split("/")
            if not all(parts) or any(p in (".", "..") or p.startswith("_") for p in parts):
                raise ValueError(f"no name for a file: {row['name']!r}")
            folder = "/".join([path, *parts[:-1]])
            if folder not in made:
                files.create_dir(folder)
                made.add(folder)
            body = row["body"] or b""
            with files.open_output_stream(f"{attempt}/{n}") as f:
                f.write(body.encode() if isinstance(body, str) else bytes(body))
            files.move(f"{attempt}/{n}", f"{folder}/{parts[-1]}")
        return Written(n, attempt)

    def _clean(self) -> tuple[fs.FileSystem, str]:
        files, path = store(self.folder)
        if files.get_file_info(f"{path}/_temporary/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{path}/_temporary/{self.job}")
        return files, path

    def commit(self, messages: list[Written | None]) -> None:
        files, path = self._clean()
        files.create_dir(path)
        with files.open_output_stream(f"{path}/_SUCCESS") as f:
            f.write(json.dumps({"files": sum(m.files for m in messages if m)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()


class NamedFiles(DataSource):
    """``df.select("name", "body").write.format("named_files").mode("append").save(folder)``: one file for each row."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFileWriter:
        return NamedFileWriter(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    """Make both known to a session, with conditions handed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MessageFolder, NamedFiles):
        spark.dataSource.register(source)
    return spark
