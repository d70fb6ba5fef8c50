"""WARC archives: written as text files, read back by a Python data source.

Writing. Payloads are compared by SHA-1. Of records with equal payloads of at least ``min_bytes``
bytes that with the largest page_id is the response, the others are revisits that refer to it and hold
no payload. Digests and decisions are narrow rows; whole pages cross the network once, to meet their
decision. A record is the value of one row and Spark's text writer ends it with the record separator,
so files are committed as any others: a task that is run again leaves one file.

Reading. One partition for each file; sizes are set by the writer's partitions. Filters on record_type,
page_id, url and payload_digest are pushed down: headers are parsed first, and the
block of a record that fails them is passed over. A block is only decoded if a column that needs it
(``payload``) is in the schema. Responses are checked against their digest.

Defined cases: null html is an empty payload; a null page_id or url leaves out its header, and a null
page_id comes before all others; of repeated rows one is the response and the others revisit it; an
empty table gives an archive without records. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

MIN_BYTES = 0
#: The records' date; a parameter, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"

SCHEMA = (
    "record_type STRING, record_id STRING, page_id BIGINT, url STRING, payload_bytes BIGINT,"
    " payload_digest STRING, refers_to BIGINT, payload STRING"
)


def base32_sha1(payload: Column) -> Column:
    """The digest in upper-case base 32: five hexadecimal digits are four of base 32."""
    hexed = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _decisions(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(key, digest, response): the page that the records of a digest refer to; null for small ones."""
    narrow = pages.select(_key(F.col("page_id")), "page_id", _payload("html").alias("payload")).select(
        "key", "page_id", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("bytes")
    )
    winners = narrow.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("response"))
    return narrow.select("key", "digest").distinct().join(winners, "digest", "left")


def _payload(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _key(page_id: Column) -> Column:
    return F.coalesce(page_id.cast("string"), F.lit("")).alias("key")


def _header(name: str, value: Column) -> Column:
    """A header line; nothing if the value is null. Line ends in a value would end the header."""
    clean = F.regexp_replace(value.cast("string"), "[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(EOL)), F.lit(""))


def _record_id(page: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), page, F.lit(":"), copy, F.lit(">"))


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(value): the text of one record per page, without the separator after it."""
    whole = pages.select(_key(F.col("page_id")), "page_id", "url", _payload("html").alias("payload"))
    whole = whole.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload"))
    same = Window.partitionBy("key", "digest").orderBy("key")
    met = whole.join(_decisions(pages, min_bytes), ["key", "digest"]).withColumn("copy", F.row_number().over(same))
    large = F.col("bytes") >= min_bytes
    revisit = large & (~F.col("page_id").eqNullSafe(F.col("response")) | (F.col("copy") > 1))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"),
        _header("Content-Length", F.col("bytes")),
        F.lit(EOL),
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    response = _record_id(_key(F.col("response")), F.lit(1))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id(F.col("key"), F.col("copy"))),
        F.lit(f"WARC-Date: {DATE}{EOL}"),
        _header("WARC-Target-URI", F.col("url")),
        _header("X-Page-ID", F.col("page_id")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Refers-To", F.when(revisit, response)),
        _header("X-Refers-To-Page-ID", F.when(revisit, F.col("response"))),
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}"),
        _header("Content-Length", F.octet_length("block")),
        F.lit(EOL),
    )
    return met.withColumn("block", block).select(F.concat(head, "block").alias("value"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write the pages as gzipped WARC files to a new folder, one per partition."""
    records(pages, min_bytes).write.option("lineSep", EOL * 2).option("compression", "gzip").text(path)


class ArchiveFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WarcReader(DataSourceReader):
    #: Columns that are known when the headers are.
    HEADED = ("record_type", "record_id", "page_id", "url", "payload_digest", "refers_to")
    BATCH = 4 << 20

    def __init__(self, options: dict, schema) -> None:
        self.path = options["path"]
        self.columns = schema.fieldNames()
        self.wanted: list[tuple[str, tuple]] = []
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in self.HEADED and isinstance(f, EqualTo):
                self.wanted.append((name, (f.value,)))
            elif name in self.HEADED and isinstance(f, In):
                self.wanted.append((name, tuple(f.value)))
            elif name in self.HEADED and isinstance(f, IsNotNull):
                self.present.append(name)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = pyarrow.fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        files = sorted(f.path for f in found if f.is_file and f.base_name[0] not in "._")
        return [ArchiveFile(f) for f in files] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for row in self._rows(partition.path):
            rows.append(row)
            size += 200 + len(row.get("payload") or "")
            if size >= self.BATCH:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
        arrays = [pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.columns]
        return pa.RecordBatch.from_arrays(arrays, self.columns)

    def _rows(self, path: str) -> Iterator[dict]:
        if not path:
            return
        store, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(path, compression=None) as raw:
            lines = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 18)
            while True:
                line = lines.readline()
                if not line:
                    return
                if not line.startswith(b"WARC/"):
                    continue  # the separator between records
                head = _headers(lines)
                length = int(head["content-length"])
                row = _known(head)
                if any(row[n] not in values for n, values in self.wanted) or any(row[n] is None for n in self.present):
                    _skip(lines, length)
                    continue
                http, payload = _http(lines, length)
                row["payload_bytes"] = int(http.get("content-length", len(payload)))
                row["payload"] = None
                if row["record_type"] == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if found != row["payload_digest"]:
                        raise ValueError(f"{path}: {row['record_id']} has the digest {found}, not {row['payload_digest']}")
                    if "payload" in self.columns:
                        row["payload"] = payload.decode("utf-8", "replace")
                yield row


def _headers(lines: io.BufferedReader) -> dict[str, str]:
    found: dict[str, str] = {}
    while (line := lines.readline().decode("utf-8", "replace").rstrip("\r\n")) != "":
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _known(head: dict[str, str]) -> dict:
    number = lambda name: int(head[name]) if name in head else None
    return {
        "record_type": head.get("warc-type"),
        "record_id": head.get("warc-record-id"),
        "page_id": number("x-page-id"),
        "url": head.get("warc-target-uri"),
        "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "refers_to": number("x-refers-to-page-id"),
    }


def _skip(lines: io.BufferedReader, length: int) -> None:
    while length > 0 and (read := len(lines.read(min(length, 1 << 20)))):
        length -= read


def _http(lines: io.BufferedReader, length: int) -> tuple[dict[str, str], bytes]:
    """The HTTP headers and the payload of a block."""
    head, _, payload = lines.read(length).partition(b"\r\n\r\n")
    return _headers(io.BufferedReader(io.BytesIO(head + b"\r\n\r\n"))), payload


class WarcSource(DataSource):
    """``spark.read.format("warc").schema(...).load(folder)``; SCHEMA has all columns there are."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)


def read_archive(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The records of an archive; columns that are not in the schema are not made."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # With the scheme of the file system that Spark takes the path for.
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = whole.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(whole)
    return spark.read.format("warc").schema(schema).load(whole.toString())
