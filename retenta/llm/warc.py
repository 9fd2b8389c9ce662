"""WARC archives: a writer, a normaliser of monolithic gzip files, and an indexed reader.

Many archives are one gzip stream from end to end, so no record can be read without all
that stands before it. The normaliser inflates such a file once, as a stream, and rewrites
every record as a gzip member of its own; beside the new archive it writes an index with
each member's offset and length. With it any record is read by itself, and a reader's work
is dealt out by byte ranges of the archives instead of by files.

- :func:`write_archives` makes records of pages and lets Spark's text writer put them into
  files that are one gzip stream each. Of pages with equal payloads the one of the largest
  id is a ``response``; the others are ``revisit`` records without payload that refer to it.
- :func:`normalise` reads such files through Spark (in any store it knows) and writes
  ``*.warc.gz`` and ``*.jsonl`` beside them. A record passes through in pieces, so memory
  holds a piece of the text between two blank lines. A file is one task's work, since a
  monolithic stream can be inflated from its start only.
- :func:`read_records` reads by the index.

New archives are written with Arrow's file systems (local, HDFS, S3 and such) under a name
of the attempt's own and then moved to the name that follows from the source, so a task
that runs twice leaves the same files.

Cases: a null payload counts as empty; a null id sorts below all others and is null again
when read; of rows equal in id, url and payload one is the response and the others revisit
it; of an id's rows with equal payload and different urls that of the larger url is the
response (null: least); payloads may hold anything, blank lines, WARC records and bytes
that are no UTF-8 included; line ends in urls are percent-encoded; no pages give no
records; other columns are not looked at. An archive that ends within a record, or has
none, raises a ValueError that names it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retenta.llm.staging import attach, shared_root, staged

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: shared payloads whose digests and first pages are broadcast; more are joined
FEW_SHARED = 10_000
#: level of the members' compression
LEVEL = 6
#: bytes of one read, and of the slices of archives that tasks read
READ_BYTES = 8 << 20
SLICE_BYTES = 16 << 20
OUT_BYTES = 4 << 20
OUT_ROWS = 1000


def base32_of(hex_digest: Column) -> Column:
    """The base32 form of a 40-digit hexadecimal SHA-1: five digits of the one are four of
    the other."""
    fives = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"),
    )
    return rows.withColumns({"digest": F.unhex(F.sha1(F.col("payload").cast("binary"))), "size": F.octet_length("payload").cast("long")})


def _first_of(rows: DataFrame, facts: DataFrame, few: bool) -> DataFrame:
    """``rows`` with ``first``, the response's (id, url) where others share their payload."""
    return rows.join(F.broadcast(facts), "digest", "left") if few else attach(rows, facts, "digest", F.struct("id", "url"))


def _urn(page: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.concat(F.lit("v"), F.url_encode(page.cast("string"))), F.lit("n")), F.lit("."), digest)


def _record(kind: str, body: Column, copy: Column) -> Column:
    """A whole record but for the blank line that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END), body)
    digest = base32_of(F.hex("digest"))
    head = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n"),
        line("WARC-Record-ID", F.concat(_urn(F.col("id"), digest), F.lit("."), copy.cast("string"), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
    ]
    if kind == "revisit":
        head += [line("WARC-Refers-To", F.concat(_urn(F.col("first.id"), digest), F.lit(".1>"))), F.lit(f"WARC-Profile: {PROFILE}\r\n")]
    head += [F.lit("Content-Type: application/http;msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n")]
    return F.concat(*head, block)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write a record per page to files in ``folder`` (new), each one gzip stream. Payloads of
    fewer than ``min_bytes`` bytes are written again for each page."""
    rows = _rows(pages, id_col, url_col, payload_col)
    here = F.struct("id", "url")
    # sizes and digests only: how often each page is there, and which payloads are shared
    distinct = staged(rows.groupBy("digest", "size", "id", "url").agg(F.count(F.lit(1)).alias("n")), "warc-pages")
    large = distinct.filter(F.col("size") >= min_bytes)
    shared = large.groupBy("digest").agg(F.max(here).alias("first"), F.sum("n").alias("pages")).filter("pages > 1").select("digest", "first")
    shared = staged(shared, "warc-shared")
    few = shared.count() <= FEW_SHARED
    # a payload that one page has is written where it is read
    marked = _first_of(rows, shared, few)
    alone = marked.filter(F.col("first").isNull()).withColumn("copy", F.monotonically_increasing_id() + 1)
    chosen = marked.filter(here.eqNullSafe(F.col("first"))).dropDuplicates(["digest"]).withColumn("copy", F.lit(1).cast("long"))
    responses = alone.unionByName(chosen).select(_record("response", F.col("payload"), F.col("copy")).alias("value"))
    again = _first_of(distinct, shared, few).filter(F.col("first").isNotNull())
    times = F.col("n") - F.when(here.eqNullSafe(F.col("first")), 1).otherwise(0)
    again = again.withColumn("times", times).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(2).cast("long"), F.col("times") + 1)))
    revisits = again.select(_record("revisit", F.lit(""), F.col("copy")).alias("value"))
    responses.unionByName(revisits).write.option("lineSep", END).option("compression", "gzip").text(folder)


class Members:
    """Takes a stream of records in pieces and gives each record as a gzip member."""

    def __init__(self, source: str):
        self.source, self.head, self.left, self.members = source, b"", None, 0
        self.packer, self.fields = None, {}

    def feed(self, data: bytes) -> Iterator[tuple[bytes, dict | None]]:
        """(bytes to write, the record's header fields if these bytes end it)."""
        while data or self.left == 0:
            if self.left is None:
                self.head = (self.head + data).lstrip(b"\r\n")
                at = self.head.find(END.encode())
                if at < 0:
                    return
                head, data, self.head = self.head[: at + 4], self.head[at + 4 :], b""
                self.fields = fields_of(head)
                if not head.startswith(b"WARC/") or not self.fields.get("content-length", "").isdigit():
                    raise ValueError(f"no WARC record where one should start: {self.source}")
                self.left = int(self.fields["content-length"])
                self.packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                yield self.packer.compress(head), None
            part, data = data[: self.left], data[self.left :]
            self.left -= len(part)
            yield self.packer.compress(part), None
            if not self.left:
                self.left = None
                self.members += 1
                yield self.packer.compress(END.encode()) + self.packer.flush(), self.fields

    def close(self) -> None:
        if self.left or self.head.strip(b"\r\n") or not self.members:
            raise ValueError(f"archive ends within a record, or has none: {self.source}")


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by their names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines) if name}


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a folder, and the folder's path there."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class _Archive:
    """One normalised archive that is being written, and its index."""

    def __init__(self, source: str, folder: str):
        self.source, self.members = source, Members(source)
        stem = source.rsplit("/", 1)[-1].split(".")[0]
        self.name = f"{stem}-{hashlib.sha1(source.encode()).hexdigest()[:12]}.warc.gz"
        self.fs, self.folder = file_system(folder)
        self.own = f"{self.folder}/{self.name}.{uuid.uuid4().hex}"
        self.out, self.index = self.fs.open_output_stream(f"{self.own}.tmp", compression=None), self.fs.open_output_stream(f"{self.own}.idx.tmp", compression=None)
        self.start = self.at = 0

    def feed(self, data: bytes) -> None:
        for packed, record in self.members.feed(data):
            self.out.write(packed)
            self.at += len(packed)
            if record is not None:
                entry = {"archive": self.name, "offset": self.start, "length": self.at - self.start, "kind": record.get("warc-type"), "record_id": record.get("warc-record-id"), "uri": record.get("warc-target-uri")}
                self.index.write(json.dumps(entry).encode() + b"\n")
                self.start = self.at

    def close(self) -> tuple[str, str, int, int]:
        # a blank line at the file's end is not handed over by the reader
        self.feed(END.encode() if self.members.left else b"")
        self.members.close()
        self.out.close()
        self.index.close()
        self.fs.move(f"{self.own}.tmp", f"{self.folder}/{self.name}")
        self.fs.move(f"{self.own}.idx.tmp", f"{self.folder}/{self.name}.jsonl")
        return self.source, self.name, self.members.members, self.at


def normalise(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Rewrite the monolithic archives under ``source`` into ``folder``. Returns (source,
    archive, records, bytes), a row a file."""
    pieces = spark.read.option("lineSep", END).text(source)
    pieces = pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    where, path = file_system(folder)
    where.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Archive | None = None
        done: list[tuple[str, str, int, int]] = []
        for batch in batches:
            values = batch.column("value")
            for i, file in enumerate(batch.column("file").to_pylist()):
                if now is None or file != now.source:
                    if now is not None:
                        done.append(now.close())
                    now = _Archive(file, folder)
                else:
                    now.feed(END.encode())
                now.feed(values[i].as_py())
        if now is not None:
            done.append(now.close())
        columns = list(zip(*done)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["source", "archive", "records", "bytes"])

    return staged(pieces.mapInArrow(run, "source string, archive string, records long, bytes long"), "warc-archives")


INDEX = "archive string, offset long, length long, kind string, record_id string, uri string"


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index of all archives in ``folder``."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.jsonl").json(folder)


def page_of(urn: str | None) -> str | None:
    """The page id in a record's name."""
    name = (urn or "").removeprefix("<urn:page:").rsplit(".", 2)[0]
    return unquote_plus(name[1:]) if name[:1] == "v" else None


def parsed(member: bytes) -> dict:
    """A record of one gzip member: its fields and, of a response, its payload."""
    raw = zlib.decompress(member, 31)
    at = raw.find(END.encode()) + 4
    fields = fields_of(raw[:at])
    block = raw[at : at + int(fields["content-length"])]
    http = block.find(END.encode()) + 4
    revisit = fields["warc-type"] == "revisit"
    return {
        "page_id": page_of(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "refers_to": page_of(fields["warc-refers-to"]) if revisit else None, "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "http_length": int(fields_of(block[:http]).get("content-length", 0)), "payload": None if revisit else block[http:],
    }


RECORD = "page_id string, url string, record_type string, refers_to string, digest string, http_length long, payload binary"
_ARROW = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary())])


def read_records(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """The records that ``index`` (by default the whole one) names: page_id, url, record_type,
    refers_to, digest, http_length and payload (null of a revisit). Members that lie side by
    side are read at once, up to READ_BYTES."""
    index = read_index(spark, folder) if index is None else index
    dealt = index.select("archive", "offset", "length", F.expr(f"offset div {SLICE_BYTES}").alias("slice"))
    # an index row is small and stands for much to read, so tasks are counted by slices
    slices = dealt.select("archive", "slice").distinct().count()
    dealt = dealt.repartition(max(1, slices), "archive", "slice").sortWithinPartitions("archive", "offset")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[int]]]:
        archive, start, lengths, total = None, 0, [], 0
        for batch in batches:
            for a, offset, length, _ in zip(*[c.to_pylist() for c in batch.columns]):
                if a != archive or offset != start + total or total + length > READ_BYTES:
                    if lengths:
                        yield archive, start, lengths
                    archive, start, lengths, total = a, offset, [], 0
                lengths.append(length)
                total += length
        if lengths:
            yield archive, start, lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = file_system(folder)
        name, stream = None, None
        done: list[dict] = []
        size = 0
        for archive, start, lengths in spans(batches):
            if archive != name:
                name, stream = archive, where.open_input_file(f"{path}/{archive}")
            data, at = stream.read_at(sum(lengths), start), 0
            for length in lengths:
                record = parsed(data[at : at + length])
                at += length
                done.append(record)
                size += len(record["payload"] or b"")
                if len(done) >= OUT_ROWS or size >= OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(done, _ARROW)
                    done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, _ARROW)

    return dealt.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Pages written to monolithic archives in the shared folder, normalised, and read back
    by the index: :func:`read_records` with ``page_id`` and ``refers_to`` in the id's type."""
    spark = pages.sparkSession
    root = f"{shared_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{root}/monolithic", id_col, url_col, payload_col, min_bytes)
    normalise(spark, f"{root}/monolithic", f"{root}/members")
    kind: T.DataType = pages.schema[id_col].dataType
    return read_records(spark, f"{root}/members").withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def digests(records: DataFrame) -> DataFrame:
    """Size and SHA-1 of the full payload of each record: of a response from what was read,
    of a revisit from what it states. ``intact``: the two agree where both are known."""
    read = F.col("payload").isNotNull()
    sha1 = F.when(read, base32_of(F.sha1("payload"))).otherwise(F.col("digest"))
    size = F.when(read, F.octet_length("payload").cast("long")).otherwise(F.col("http_length"))
    return records.select("page_id", size.alias("payload_bytes"), sha1.alias("payload_digest"), "record_type", "refers_to", ((sha1 == F.col("digest")) & (size == F.col("http_length"))).alias("intact"))
