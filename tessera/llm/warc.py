"""WARC files: writing, reading, and assembly of transactions.

A capture is what was exchanged over one fetch: a response, its requests and
metadata records about it, tied together by WARC-Concurrent-To headers, of
which a record may have several.

* `write` makes WARC 1.0 files, one gzip member a record and one file a task,
  each under a name of its own attempt; only the files of attempts that
  succeeded are returned.
* `read` streams such files (gzip or plain), record by record, one task a
  file, and splits HTTP payloads into start line, headers and body. A file is
  never held in memory, a record is.
* `assemble` groups records by the response they belong to. Usually that is a
  response's own id, and the concurrent-to id of the others. Records that name
  several ids belong to every response among them. Where none of the ids is a
  response (metadata that points to a request, a request that its response
  points to), links are followed over the ids alone, in both directions: up to
  two links, and for what is left by connected components. The ids that this
  redirects are joined to the records.

Defined results: of records that repeat an id and type, and of responses that
share an id, the greatest by (date, uri, start line, headers, body) counts;
requests and metadata form lists by id, and none is dropped; requests and
metadata whose links lead to no response form a capture of their own without
one; a record without id or type, or of another type (warcinfo, revisit, ...),
is no part of any capture; null payloads are null bodies; linked ids without
any response belong to the least of them, and those with several to the least
response; an empty table gives an empty table; further columns are ignored.
What can't be read is left out, and reading goes on at the next line that
begins a record: a head without version or length, and what follows a record
whose length is too small; behind a damaged gzip member, at the next member. A
record that the end of the file or a damaged member cuts off is left out.
"""

from __future__ import annotations

import gzip
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm.components import connected_components

RECORD = "warc_type string, record_id string, concurrent_to array<string>, target_uri string, date string, content_type string, start_line string, http_headers string, body binary"
_FIELDS = ["warc_type", "record_id", "concurrent_to", "target_uri", "date", "content_type", "start_line", "http_headers", "body"]
_READ_BYTES = 1 << 20
#: A side of a join is broadcast up to this estimated size, and shuffled beyond it.
BROADCAST_BYTES = 32_000_000


def record_bytes(kind: str, record_id: str, concurrent_to: list[str] | None, uri: str | None, date: str | None, content_type: str | None, payload: bytes) -> bytes:
    """One record, with its closing line ends."""
    lines = [b"WARC/1.0"]
    for name, value in (("WARC-Type", kind), ("WARC-Record-ID", record_id and f"<{record_id}>"), *(("WARC-Concurrent-To", to and f"<{to}>") for to in concurrent_to or []), ("WARC-Target-URI", uri), ("WARC-Date", date), ("Content-Type", content_type), ("Content-Length", str(len(payload)))):
        if value is not None:
            lines.append(f"{name}: {value}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _payload(start_line: str | None, headers: str | None, body: bytes | None) -> bytes:
    if start_line is None:
        return body or b""
    head = start_line + "\r\n" + (headers + "\r\n" if headers else "") + "\r\n"
    return head.encode("utf-8", "surrogateescape") + (body or b"")


def write(records: DataFrame, path: str) -> list[str]:
    """Write records (columns of `RECORD`) as gzip files under `path` and return their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
        count = 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for kind, rid, to, uri, date, ctype, start, headers, body in zip(*(batch.column(k).to_pylist() for k in range(len(_FIELDS)))):
                    out.write(gzip.compress(record_bytes(kind, rid, to, uri, date, ctype, _payload(start, headers, body)), 6, mtime=0))
                    count += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["name", "records"])

    # one row a file: the listing is as long as the number of files
    written = records.select(*_FIELDS).mapInArrow(run, "name string, records bigint").collect()
    return sorted(f"{path}/{r.name}" for r in written if r.records)


class _Stream:
    """Decompressed bytes of a file of gzip members, or of a plain file."""

    def __init__(self, source):
        self.source, self.held, self.at, self.ended = source, bytearray(), 0, False
        self.inflate = None
        self.cut: int | None = None  # where bytes are missing, in held
        head = source.read(_READ_BYTES)
        self.zipped = head[:2] == b"\x1f\x8b"
        self._take(head)

    def _take(self, raw: bytes) -> None:
        if self.at > len(self.held) // 2:
            del self.held[: self.at]
            self.cut = None if self.cut is None or self.cut < self.at else self.cut - self.at
            self.at = 0
        if not raw:
            self.ended = True
        elif not self.zipped:
            self.held += raw
        while raw and self.zipped:
            if self.inflate is None:
                begin = raw.find(b"\x1f\x8b\x08")
                if begin < 0:
                    return
                raw, self.inflate = raw[begin:], zlib.decompressobj(31)
            try:
                self.held += self.inflate.decompress(raw)
            except zlib.error:
                self.inflate, raw = None, raw[1:]
                self.cut = len(self.held) if self.cut is None else self.cut
                self.held += b"\r\n"
                continue
            raw = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = None

    def more(self) -> bool:
        """Whether there was anything left to read."""
        if not self.ended:
            self._take(self.source.read(_READ_BYTES))
        return not self.ended

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while True:
            found = self.held.find(mark, self.at + seen)
            if found >= 0:
                piece = bytes(self.held[self.at : found])
                self.at = found + len(mark)
                return piece
            seen = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.more():
                return None

    def exactly(self, n: int) -> bytes | None:
        """The next n bytes; None, and nothing or what is missing passed over, if there aren't so many in one piece."""
        while len(self.held) - self.at < n and self.cut is None and self.more():
            pass
        if self.cut is not None and self.at <= self.cut < self.at + n:
            self.at, self.cut = self.cut, None
            return None
        if len(self.held) - self.at < n:
            return None
        piece = bytes(self.held[self.at : self.at + n])
        self.at += n
        return piece

    def to_record(self, back: int) -> bool:
        """Go back and then on to the next line that begins a record; whether there is one."""
        self.at -= back
        while True:
            found = self.held.find(b"\nWARC/", self.at)
            if found >= 0:
                self.at = found + 1
                return True
            self.at = max(self.at, len(self.held) - 5)
            if not self.more():
                return False


def _id(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def parse(source) -> Iterator[tuple]:
    """The records of one open file, in the columns of `RECORD`."""
    stream = _Stream(source)
    while True:
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        if not head.strip(b"\r\n"):
            continue
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        named, beside = {}, []
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if colon:
                named[name.strip().lower()] = value.strip()
                if name.strip().lower() == "warc-concurrent-to" and value.strip():
                    beside.append(_id(value.strip()))
        size = named.get("content-length", "")
        if not lines[0].startswith("WARC/") or not (size.isascii() and size.isdigit()):
            if not stream.to_record(len(head.lstrip(b"\r\n")) + 4):
                return
            continue
        payload = stream.exactly(int(size))
        if payload is None:
            if not stream.to_record(0):
                return
            continue
        kind, ctype = named.get("warc-type"), named.get("content-type")
        start = headers = None
        body = payload
        if ctype and ctype.lower().startswith("application/http"):
            top, _, body = payload.partition(b"\r\n\r\n")
            first, _, others = top.decode("utf-8", "replace").partition("\r\n")
            start, headers = first, others
        yield kind, _id(named.get("warc-record-id")), beside or None, named.get("warc-target-uri"), named.get("warc-date"), ctype, start, headers, body


def read(spark: SparkSession, paths: list[str], records_a_batch: int = 500, bytes_a_batch: int = 8_000_000) -> DataFrame:
    """The records (columns of `RECORD`) of all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f, pa.binary() if f == "body" else pa.list_(pa.string()) if f == "concurrent_to" else pa.string()) for f in _FIELDS])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as source:
                    rows, size = [], 0
                    for row in parse(source):
                        rows.append(row)
                        size += len(row[-1] or b"")
                        if len(rows) >= records_a_batch or size >= bytes_a_batch:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    if not paths:
        return spark.createDataFrame([], RECORD)
    listing = spark.sparkContext.parallelize([(p,) for p in paths], len(paths)).toDF("path string")
    return listing.mapInArrow(run, RECORD)


def _anchors(records: DataFrame) -> DataFrame:
    """(warc_type, record_id, anchor): the captures of requests and metadata that don't name one response and nothing else."""
    beside = F.array_distinct(F.array_compact(F.coalesce("concurrent_to", F.expr("cast(array() as array<string>)"))))
    links = scratch.materialise(records.select("warc_type", "record_id", beside.alias("beside")), "links")
    responses = links.where("warc_type = 'response'").select(F.col("record_id").alias("r")).distinct()
    others = links.where("warc_type != 'response'")
    whose = ["warc_type", "record_id"]
    single = others.where("size(beside) < 2").select(*whose, F.coalesce(F.get("beside", F.lit(0)), "record_id").alias("key"))
    loose = single.join(responses, F.col("key") == F.col("r"), "left_anti").select(*whose)
    several = others.where("size(beside) > 1").select(*whose, F.explode("beside").alias("to"))
    direct = several.join(responses, F.col("to") == F.col("r")).select(*whose, F.col("r").alias("anchor"))
    loose = loose.unionByName(several.select(*whose).distinct().join(direct, whose, "left_anti"))
    direct, loose = scratch.materialise(direct.distinct(), "direct"), scratch.materialise(loose.distinct(), "loose")
    if loose.isEmpty():
        return direct
    edges = links.select(F.col("record_id").alias("a"), F.explode("beside").alias("b")).where("a != b").distinct()
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    by_response = ways.join(responses, F.col("b") == F.col("r"), "left_semi").groupBy("a").agg(F.min("b").alias("anchor"))
    near = scratch.materialise(loose.join(by_response, F.col("record_id") == F.col("a"), "left").select(*whose, "anchor"), "near")
    found = direct.unionByName(near.where("anchor is not null"))
    left = near.where("anchor is null").select(*whose)
    if left.isEmpty():
        return found
    over_one = ways.join(left.select(F.col("record_id").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("of"), "b").join(by_response, F.col("b") == F.col("a")).groupBy("of").agg(F.min("anchor").alias("anchor"))
    near = scratch.materialise(left.join(over_one, F.col("record_id") == F.col("of"), "left").select(*whose, "anchor"), "near")
    found = found.unionByName(near.where("anchor is not null"))
    left = near.where("anchor is null").select(*whose)
    if left.isEmpty():
        return found
    parts = scratch.materialise(connected_components(edges, "a", "b"), "parts")
    best = parts.join(responses, F.col("node") == F.col("r")).groupBy("root").agg(F.min("r").alias("response"))
    led = left.join(parts, F.col("record_id") == F.col("node"), "left").join(best, "root", "left").select(*whose, F.coalesce("response", "root", "record_id").alias("anchor"))
    return found.unionByName(led)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, target_uri, date, requests, response and metadata."""
    records = records.select(*_FIELDS).where(F.col("warc_type").isin("request", "response", "metadata") & F.col("record_id").isNotNull())
    anchors = _anchors(records)
    weight = anchors.select(F.sum(F.octet_length("record_id") + F.octet_length("anchor") + 60)).first()[0] or 0
    keyed = records.join(F.broadcast(anchors) if weight <= BROADCAST_BYTES else anchors, ["warc_type", "record_id"], "left")
    own = F.when(F.col("warc_type") == "response", F.col("record_id")).otherwise(F.coalesce(F.get(F.array_compact("concurrent_to"), F.lit(0)), "record_id"))
    keyed = keyed.withColumn("capture_id", F.coalesce("anchor", own))
    http = F.struct("record_id", "date", "target_uri", "start_line", "http_headers", "body")
    about = F.struct("record_id", "date", "target_uri", "content_type", "body")
    only = lambda kind, value: F.when(F.col("warc_type") == kind, value)
    grouped = keyed.groupBy("capture_id").agg(
        F.sort_array(F.collect_set(only("request", http))).alias("requests"),
        F.max(only("response", http)).alias("response"),
        F.sort_array(F.collect_set(only("metadata", about))).alias("metadata"),
    )
    requests = F.aggregate("requests", F.expr("cast(array() as array<struct<record_id:string,date:string,target_uri:string,start_line:string,http_headers:string,body:binary>>)"), _last_of_each)
    metadata = F.aggregate("metadata", F.expr("cast(array() as array<struct<record_id:string,date:string,target_uri:string,content_type:string,body:binary>>)"), _last_of_each)
    grouped = grouped.withColumns({"requests": requests, "metadata": metadata})
    first = lambda field: F.coalesce(F.col(f"response.{field}"), F.get("requests", F.lit(0))[field], F.get("metadata", F.lit(0))[field])
    return grouped.select("capture_id", first("target_uri").alias("target_uri"), first("date").alias("date"), "requests", "response", "metadata")


def _last_of_each(kept: Column, one: Column) -> Column:
    """Of entries in order, the last of each record id."""
    same = (F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1))["record_id"] == one["record_id"])
    return F.when(same, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(one))).otherwise(F.concat(kept, F.array(one)))


def status_of(start_line: Column) -> Column:
    return F.get(F.split(start_line, " "), F.lit(1)).try_cast("int")


def of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records of a crawl that fetched `pages`: request, response and metadata of each, with ids made from the page's id.

    Requests and metadata name the response, as crawlers write them; but of
    every tenth page the metadata names the request too, and of another tenth
    the request names nothing and is named by its response.
    """
    urn = lambda kind: F.concat(F.lit(f"urn:page:{kind}:"), F.col("id"))
    base = pages.select(pages[id_col].cast("string").alias("id"), pages[url_col].alias("url"), pages[html_col].cast("binary").alias("html")).where("id is not null")
    date = F.lit("2024-01-01T00:00:00Z")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^#]*)", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    record = lambda kind, to, ctype, start, headers, body: F.struct(F.lit(kind).alias("warc_type"), urn(kind).alias("record_id"), to.alias("concurrent_to"), F.col("url").alias("target_uri"), date.alias("date"), F.lit(ctype).alias("content_type"), start.alias("start_line"), headers.alias("http_headers"), body.alias("body"))
    none = F.lit(None).cast("string")
    kind = F.pmod(F.xxhash64("id"), F.lit(10))
    to_response = F.array(urn("response"))
    request = record("request", F.when(kind != 5, to_response), "application/http; msgtype=request", F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1")), F.concat(F.lit("Host: "), host), F.lit(b""))
    response = record("response", F.when(kind == 5, F.array(urn("request"))), "application/http; msgtype=response", F.lit("HTTP/1.1 200 OK"), F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string")), F.col("html"))
    metadata = record("metadata", F.when(kind == 0, F.array(urn("response"), urn("request"))).otherwise(to_response), "application/warc-fields", none, none, F.concat(F.lit("outlinks: "), F.regexp_count("html", F.lit('<a href="')).cast("string"), F.lit("\r\n")).cast("binary"))
    return base.select(F.explode(F.array(request, response, metadata)).alias("r")).select("r.*")


def flat(captures: DataFrame) -> DataFrame:
    """The nested rows spread out into plain columns."""
    return captures.select(
        "capture_id",
        "target_uri",
        F.concat_ws(" ", F.transform("requests", lambda r: r["record_id"])).alias("request_id"),
        F.concat_ws("\n", F.transform("requests", lambda r: r["start_line"])).alias("request_line"),
        F.concat_ws("\n", F.transform("requests", lambda r: r["http_headers"])).alias("request_headers"),
        F.col("response.start_line").alias("status_line"),
        status_of(F.col("response.start_line")).alias("status"),
        F.col("response.http_headers").alias("response_headers"),
        F.col("response.body").cast("string").alias("body"),
        F.concat_ws(" ", F.transform("metadata", lambda m: m["record_id"])).alias("metadata_ids"),
        F.concat_ws("", F.transform("metadata", lambda m: m["body"].cast("string"))).alias("metadata_text"),
    )


def listing(path: str) -> list[str]:
    """The WARC files under `path`, for `read`."""
    fs, root = pafs.FileSystem.from_uri(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    return sorted(scheme + f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and os.path.basename(f.path).endswith((".warc", ".warc.gz")))
