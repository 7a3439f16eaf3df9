"""WARC archives: a Spark sink and a PySpark Python data source.

Writing: a record is text, so the text sink writes it, with the record's terminator as the line separator, to any store
that Spark writes to and with its committer. Reading: the source plans a partition for each file, takes equality and IN
predicates on record type, id, URI and digest, parses a record's headers first and seeks past the payloads of records
that no one asked for.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import fresh_path, table, written

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
#: Header names of the WARC format by column, and what ends a record.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Groups of equal payloads up to which they are broadcast to the rows; beyond, both are shuffled.
BROADCAST_ROWS = 500_000


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.options, self.schema = options, to_arrow_schema(schema)
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in HEADERS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.options["path"])
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = [f.path for f in found if f.type == pafs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]
        return [WarcFile(p) for p in sorted(files)]

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        fs, _ = pafs.FileSystem.from_uri(self.options["path"])
        payloads = self.options.get("payload", "true").lower() != "false"
        with fs.open_input_file(partition.path) as raw:
            rows, size = [], 0
            for row in records(gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw, self.wanted, payloads):
                rows.append(row)
                size += len(row["payload"] or b"") + 500
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, self.schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, self.schema)


def parsed(lines: list[str]) -> list[tuple[str, str]]:
    """Headers as (name, value): the blank after the colon is optional, a line that begins with one continues the header before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def first(headers: list[tuple[str, str]], name: str, default: str | None = None) -> str | None:
    """The first header of that name, whatever its case."""
    return next((v for n, v in headers if n.lower() == name.lower()), default)


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def decoded(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """An HTTP body without its chunks and its gzip or deflate coding. What is not coded as its headers say, or in another coding, stays as it is."""
    if "chunked" in (first(headers, "Transfer-Encoding") or "").lower():
        out, at = [], 0
        while m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n").match(body, at):
            size = int(m[1], 16)
            out.append(body[m.end() : m.end() + size])
            at = m.end() + size + 2
            if not size:
                break
        body = b"".join(out) if at else body
    coding = (first(headers, "Content-Encoding") or "").lower()
    try:
        return gzip.decompress(body) if coding in ("gzip", "x-gzip") else zlib.decompress(body) if coding == "deflate" else body
    except (OSError, EOFError, zlib.error):
        return body


def records(file, wanted: dict[str, set], payloads: bool) -> Iterator[dict]:
    """The records whose headers are wanted. Of a skipped record nothing after the headers is read; a record cut short or
    a payload that its digest does not fit is an error."""
    buffer, at, base = b"", 0, 0  # base: place in the file of the buffer's first byte

    def fill(n: int) -> bool:
        nonlocal buffer, at, base
        while len(buffer) - at < n:
            more = file.read(max(1 << 16, n))
            if not more:
                return False
            base, buffer, at = base + at, buffer[at:] + more, 0
        return True

    while fill(1):
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not fill(len(buffer) - at + 1):
                if not buffer[at:].strip():
                    return
                raise ValueError("a WARC record is cut short in its headers")
        head = buffer[at:end].decode("utf-8", "replace").split("\r\n")
        at = end + 4
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {head[0][:40]!r}")
        headers = parsed(head[1:])
        length = int(first(headers, "Content-Length", "0"))
        row = {c: first(headers, h) for c, h in HEADERS.items()}
        algorithm, _, value = (row["payload_digest"] or "").rpartition(":")
        if algorithm.lower() == "sha1":
            algorithm, row["payload_digest"] = "sha1", value
        keep = all(row[c] in values for c, values in wanted.items())
        payload = None
        if keep and payloads and length:
            if not fill(length):
                raise ValueError("a WARC record is cut short in its block")
            block = buffer[at : at + length]
            payload = sent = block
            if block.startswith(b"HTTP/"):
                http, _, sent = block.partition(b"\r\n\r\n")
                payload = decoded(parsed(http.decode("latin-1").split("\r\n")[1:]), sent)
            if algorithm == "sha1" and row["record_type"] == "response" and row["payload_digest"] not in (sha1(payload), sha1(sent)):
                raise ValueError(f"the payload of {row['record_id']} does not fit its digest")
        if len(buffer) - at >= length + 4:
            at += length + 4
        else:
            file.seek(base + at + length + 4)
            base, buffer, at = base + at + length + 4, b"", 0
        if keep:
            told = first(headers, "X-Payload-Length")
            yield row | {"payload_bytes": len(payload) if payload is not None and row["record_type"] == "response" else int(told) if told else None, "headers": list(dict(reversed(headers)).items()), "payload": payload}


class WarcSource(DataSource):
    """spark.read.format("warc").load(path); option payload=false reads headers only. The path may be a file or a folder
    of .warc or .warc.gz files on any store that pyarrow reaches."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records at path, by the schema SCHEMA. Filters on the columns of HEADERS are tested on the headers alone.

    Names of headers have no case; the map has each name as it was first written, with its first value. Chunked, gzip and
    deflate bodies are decoded. A missing header is null, a missing length 0; a payload of any length is one value, a folder
    without records gives no rows, repeated records are told as often as they stand. Spark's setting for filters in Python
    sources is switched on and stays on, as the returned DataFrame cannot be read without it.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1: each 40 bits are ten hexadecimal and eight base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    """One record for each row. Of rows with equal payloads of least bytes or more, that with the largest id is the
    response and the others are revisits of it, without a payload; all others are responses.

    A null payload is empty, one of any length is one record; a null URI has no header; line breaks in a URI become
    blanks. A null id is less than any other and written as null. Rows that repeat the largest id of their payload (ties)
    are all responses. No rows, no records. Further columns are not read, whatever their names.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(uri_col, r"[\r\n]", " ").alias("uri"), payload.alias("payload"), base32_sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
    groups = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies")
    groups = written(groups, "warc-groups")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    joined = rows.join(groups, ["digest", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = [
        F.lit("WARC/1.0"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("id"))), line("WARC-Target-URI", F.col("uri")),
        F.date_format(F.current_timestamp(), "'WARC-Date: 'yyyy-MM-dd'T'HH:mm:ss'Z'"), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("first")))), F.when(revisit, F.lit(f"WARC-Profile: {REVISIT}")), line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", (F.when(revisit, 0).otherwise(F.col("n")) + len(HTTP)).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *head), F.lit(END + HTTP), F.when(revisit, "").otherwise(F.col("payload")))
    joined.select(record).write.option("lineSep", END).text(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, "^<urn:record:(.*)>$", 1).try_cast("long")
    back = read_warc(spark, path)
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS first FROM p GROUP BY h),
d AS (SELECT page_id, h, first, sha1(h) AS x FROM p JOIN g USING (h))
SELECT page_id, strlen(h) AS payload_bytes,
  translate(upper(to_base(CAST('0x' || x[1:10] AS BIGINT), 32, 8) || to_base(CAST('0x' || x[11:20] AS BIGINT), 32, 8) || to_base(CAST('0x' || x[21:30] AS BIGINT), 32, 8) || to_base(CAST('0x' || x[31:40] AS BIGINT), 32, 8)), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
