"""Replay of recorded chunks as a stream, and a folder of alerts as its end; both as Python data sources.

A recording is a folder of Parquet files in the order (start, channel, sequence), with an index of how many chunks each file
holds. An offset is a number of chunks in that order, so a restarted query goes on with the next one. A chunk is due when as much
time has passed since ``began`` as lies between the first chunk and it, divided by ``speed``; without a
speed all are due at once.

The alert folder has a file for each message and one index of all, each message once: tasks write files under
names of their own, and the driver's commit renames them and appends to the index at a place that is noted before, so a commit that
is run again leaves the same index. The folder must be one that driver and executors share.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

INDEX = "_index.json"
CHUNK = "place long, group string, start_us long, channel string, sequence long, rate double, samples array<double>"
ARROW = pa.schema([("place", pa.int64()), ("group", pa.string()), ("start_us", pa.int64()), ("channel", pa.string()), ("sequence", pa.int64()), ("rate", pa.float64()), ("samples", pa.list_(pa.float64()))])


def write_recording(chunks: DataFrame, folder: str, per_file: int = 10_000) -> None:
    """Writes chunks (group, start_us, channel, sequence, rate, samples) as a recording, spread over all tasks."""
    spark = chunks.sparkSession
    order = ["start_us", "channel", "sequence"]
    rows = chunks.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(CHUNK).fields[1:]])
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", per_file).parquet(folder)
    held = spark.read.parquet(folder).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("n"), F.min("start_us").alias("first"), F.max("start_us").alias("last"), F.min(F.struct(*order)).alias("o"))
    files, before = [], 0
    for r in held.orderBy("o").collect():  # a row a file
        files.append({"file": os.path.basename(r.path), "before": before, "n": r.n, "first": r.first, "last": r.last})
        before += r.n
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{INDEX}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(json.dumps(files).encode()))
    out.close()


def _opened(folder: str, name: str) -> pa.NativeFile:
    if "://" not in folder and not folder.startswith("file:"):
        return pa.OSFile(f"{folder}/{name}")
    files, path = pa.fs.FileSystem.from_uri(folder.replace("file:/", "file:///") if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return files.open_input_file(f"{path}/{name}")


@dataclass
class Span(InputPartition):
    """Chunks [first, last) of a file, whose first chunk of all is number ``before``."""

    file: str
    before: int
    first: int
    last: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.speed = options["path"], float(options.get("speed", 0))
        self.began = float(options.get("began", 0)) or time.time()
        self.size = int(options.get("chunksPerPartition", 5000))
        with _opened(self.folder, INDEX) as f:
            self.files = json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"place": 0}

    def latestOffset(self) -> dict:
        """How many chunks are due by now."""
        if not self.files:
            return {"place": 0}
        whole = self.files[-1]["before"] + self.files[-1]["n"]
        if not self.speed:
            return {"place": whole}
        until = self.files[0]["first"] + (time.time() - self.began) * self.speed * 1e6
        due = 0
        for f in self.files:
            if f["last"] <= until:
                due = f["before"] + f["n"]
            elif f["first"] <= until:
                with _opened(self.folder, f["file"]) as source:
                    starts = pq.read_table(source, columns=["start_us"])["start_us"].to_numpy()
                due = f["before"] + int(starts.searchsorted(until, "right"))
        return {"place": due}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for f in self.files:
            a, b = max(start["place"], f["before"]) - f["before"], min(end["place"], f["before"] + f["n"]) - f["before"]
            out += [Span(f["file"], f["before"], k, min(b, k + self.size)) for k in range(a, b, self.size)]
        return out or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span.first == span.last:
            return
        with _opened(self.folder, span.file) as source:
            table = pq.read_table(source, columns=ARROW.names[1:]).slice(span.first, span.last - span.first)
        place = pa.array(range(span.before + span.first, span.before + span.last), pa.int64())
        yield from pa.table([place, *table.columns], names=ARROW.names).cast(ARROW).to_batches()

    def commit(self, end: dict) -> None:
        pass


class Replay(DataSource):
    """``spark.readStream.format("replay")`` with options path, speed, began (seconds since 1970) and chunksPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return CHUNK

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


@dataclass
class Staged(WriterCommitMessage):
    rows: list[tuple[str, str, str]]  # identifier, staged file, entry of the index


def file_name(identifier: str) -> str:
    """A name that any file system takes; others than letters, digits, dot, dash and underscore become underscores."""
    if not (name := re.sub(r"[^A-Za-z0-9._-]", "_", identifier).strip("._")):
        raise ValueError(f"nothing of {identifier!r} can name a file")
    return f"{name[:180]}.cap.xml"


class _Writer(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.index = f"{self.folder}/index.jsonl"
        for name in ("", "_staged", "_commits"):
            os.makedirs(f"{self.folder}/{name}", exist_ok=True)

    def write(self, iterator) -> Staged:
        rows = []
        for row in iterator:
            entry = {k: v for k, v in row.asDict().items() if k != "xml"}
            if not row.xml:  # what isn't rendered isn't delivered
                continue
            staged = f"{uuid.uuid4().hex}.xml"
            with open(f"{self.folder}/_staged/{staged}", "w", encoding="utf-8") as f:
                f.write(row.xml)
            rows.append((row.identifier, staged, json.dumps(entry | {"path": file_name(row.identifier)}, sort_keys=True, default=str)))
        return Staged(rows)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        rows = sorted(r for m in messages if m is not None for r in m.rows)
        note = f"{self.folder}/_commits/{batchId}"
        if os.path.exists(note):  # run again: the index is cut to where this batch began
            with open(note) as f:
                at = int(f.read())
        else:
            at = os.path.getsize(self.index) if os.path.exists(self.index) else 0
            with open(f"{note}.new", "w") as f:
                f.write(str(at))
            os.replace(f"{note}.new", note)
        for identifier, staged, _ in rows:
            os.replace(f"{self.folder}/_staged/{staged}", f"{self.folder}/{file_name(identifier)}")
        with open(self.index, "ab") as f:
            f.truncate(at)
            f.write("".join(f"{entry}\n" for _, _, entry in rows).encode())
            f.flush()
            os.fsync(f.fileno())
        old = f"{self.folder}/_commits/{batchId - 2}"  # two batches back can't be run again
        if os.path.exists(old):
            os.remove(old)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        for m in messages:
            for _, staged, _ in m.rows if m is not None else ():
                if os.path.exists(f"{self.folder}/_staged/{staged}"):
                    os.remove(f"{self.folder}/_staged/{staged}")


class AlertFolder(DataSource):
    """``writeStream.format("alert_folder")`` with option path; rows have identifier and xml, all other columns go to the index."""

    @classmethod
    def name(cls) -> str:
        return "alert_folder"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Replay)
    spark.dataSource.register(AlertFolder)
