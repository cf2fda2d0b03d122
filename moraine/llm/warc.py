"""WARC archives with an index: written once, read back by coalesced byte ranges.

Writing: pages get the digest of their payload; of records with equal payloads of at least
``least`` bytes the one with the smallest page_id is a response, the others are revisits of it.
Each task appends one gzip member a record to files of its own, new ones at ``file_bytes``, and
returns an index row for each: file, offset, length, URL, digest. Spark commits the index as
Parquet, and only what it names counts: files of tasks that failed or ran twice are never read.

Reading: index rows go to tasks by file, sorted by offset; neighbouring ranges are read at once,
up to ``read_bytes`` and over gaps of at most ``gap_bytes``. Responses are held against their digest.

Files are opened through a filesystem chosen by the folder's URI, which driver and executors
must share.

Nulls, ties and odd inputs: a null html is an empty payload; a null page_id is never referred to
and refers to others like any row; rows that repeat page_id and payload are all responses if that
page_id is the smallest; a null URL leaves the header out. An empty table gives an empty index.
Columns other than ``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"
SALTS = 16
# Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The fields of RECORDS from one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, refers, size, digest, payload.decode() if kind == "response" else None


def typed(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses) of each page.

    What a page refers to is found among digests, salted, so that a payload on a third of all pages is
    spread; payloads are shuffled once, by page.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    long = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = long.distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = salted.join(first, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
    return rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")


def write_archives(pages: DataFrame, folder: str, least: int = 100, file_bytes: int = 64 << 20) -> None:
    """Archives in ``folder`` and their index in ``folder``/index."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in INDEX.split(", "))])

    def write(batches):
        system, path = _opened(folder)
        out = name = None
        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None or at >= file_bytes:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                packer = zlib.compressobj(5, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, html.encode(), digest, refers)) + packer.flush()
                out.write(member)
                rows.append((page_id, url, digest, "response" if refers is None else "revisit", refers, name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
        if out:
            out.close()

    system, path = _opened(folder)
    system.create_dir(path, recursive=True)
    typed(pages, least).mapInArrow(write, INDEX).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, read_bytes: int = 4 << 20, gap_bytes: int = 64 << 10) -> DataFrame:
    """The records that index rows name, in few reads; payload is null for revisits."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in RECORDS.split(", "))])

    def read(batches):
        system, path = _opened(folder)
        held, source = None, None
        for batch in batches:
            spans = list(zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))))
            k = 0
            while k < len(spans):
                file, start, length = spans[k]
                to, end = k + 1, start + length
                while to < len(spans) and spans[to][0] == file and spans[to][1] <= end + gap_bytes and spans[to][1] + spans[to][2] - start <= read_bytes:
                    end, to = max(end, spans[to][1] + spans[to][2]), to + 1
                if file != held:
                    if source:
                        source.close()
                    held, source = file, system.open_input_file(f"{path}/{file}")
                data = memoryview(source.read_at(end - start, start))
                rows = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in spans[k:to]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                k = to
        if source:
            source.close()

    return index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)
