"""WARC archives and their two-level capture index."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, scratch_path

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Index lines of a compressed block.
BLOCK_LINES = 512
#: Gaps between wanted records up to which one range read takes both, and the most that it takes.
GAP, READ = 1 << 16, 1 << 23
#: Keys that a task looks up, and stored bytes that it reads.
LOOKUPS = 20_000
PART = 4 << 20


class ArchiveError(ValueError):
    """A record or index block that isn't what the index says."""


def archive_uri(spark: SparkSession, path: str) -> str:
    """A path as a URI that executors can open, the cluster's default file system filled in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """The reversed-host form of a URL: labels of the host from the top down, then path and query, lower-case."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return quote(url or "", safe="")
    path = parts.path or "/"
    return quote(",".join(reversed(host.split("."))) + port + ")" + path + ("?" + parts.query if parts.query else ""), safe=",:)/?=&%").lower()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _page_of(record_id: str) -> int | None:
    number = record_id.split(":")[2]
    return int(number) if number else None


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a response record, or a revisit record that leaves the payload out."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[3:3] = [("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(lines.encode() + block + b"\r\n\r\n", 6, mtime=0)


def read_record(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """A member's header fields, its payload's full length, and the payload (empty for a revisit)."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ArchiveError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    if fields["WARC-Type"] == "response":
        found = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != full or found != fields["WARC-Payload-Digest"]:
            raise ArchiveError("a payload differs from its digest")
    return fields, full, payload


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of REVISIT_BYTES or more, all but the largest id refer to that.

    Groups are reduced to their largest id before anything is shuffled; the payloads then move by page, so a
    payload that a third of all pages share lands nowhere in particular.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys = materialise(rows.select("page_id", "digest", F.octet_length("payload").alias("size")), "payload-keys").where(F.col("size") >= REVISIT_BYTES)
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = keys.join(groups, "digest").where("not (page_id <=> refers_to)").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct()
    return rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write one archive a task into ``folder``; returns the captures (key, page_id, file, offset, size).

    A task's attempt writes a file of its own and names it in its rows, so after a retry the captures point to
    the attempt that counted.
    """
    bounded_batches(marked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        store.create_dir(root, recursive=True)
        at = 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                rows = []
                for page, url, payload, digest, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    member = write_record(page, url, payload, digest, refers, refers is not None)
                    out.write(member)
                    rows.append((sort_key(url, page), page, name, at, len(member)))
                    at += len(member)
                yield _captures(rows, batch.schema.field(0).type)

    kind = marked.schema["page_id"].dataType.simpleString()
    rows = marked.select("page_id", "url", "payload", "digest", "refers_to")
    return materialise(rows.mapInArrow(run, f"key string, page_id {kind}, file string, offset long, size long"), "captures")


def _captures(rows: list[tuple], page_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.string(), page_type, pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "page_id", "file", "offset", "size"])


def sort_key(url: str | None, page_id: int | None) -> str:
    """Index lines sort by these bytes: the URL key, then the page's number."""
    return f"{url_key(url)} {'-' if page_id is None else format(page_id + (1 << 63), '020d')}"


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort the captures into index files of compressed blocks; returns one row a file (file, first, last, lines).

    Beside an index file stands its sparse directory: each block's first key, offset and size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        context = TaskContext.get()
        name = f"index-{context.partitionId():05d}-{context.taskAttemptId()}"
        directory, block, at, total, first, last = [], [], 0, 0, None, ""
        out = None

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(block).encode(), 6)
            out.write(data)
            directory.append([block[0].partition("\t")[0], at, len(data)])
            at += len(data)
            block.clear()

        for batch in batches:
            for key, file, offset, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out, first = store.open_output_stream(f"{root}/{name}.blocks", compression=None), key
                block.append(f"{key}\t{file}\t{offset}\t{size}")
                total, last = total + 1, key
                if len(block) == BLOCK_LINES:
                    flush()
        if out is not None:
            if block:
                flush()
            out.close()
            with store.open_output_stream(f"{root}/{name}.directory", compression=None) as side:
                side.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (name, first, last, total)], ["file", "first", "last", "lines"])

    keyed = captures.select("key", "file", "offset", "size")
    ranged = keyed.repartitionByRange("key").sortWithinPartitions("key")
    return materialise(ranged.mapInArrow(run, "file string, first string, last string, lines long"), "index-files")


class IndexFile:
    """Binary search in one index file: in the directory for the block, then in the block."""

    def __init__(self, folder: str, name: str):
        self.store, root = open_store(folder)
        with self.store.open_input_stream(f"{root}/{name}.directory", compression=None) as side:
            self.directory = json.loads(side.read())
        self.firsts = [d[0] for d in self.directory]
        self.file = self.store.open_input_file(f"{root}/{name}.blocks")
        self.block, self.lines, self.keys = -1, [], []

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """Every capture with this key, which may run over several blocks."""
        found = []
        for block in range(max(0, bisect.bisect_left(self.firsts, key) - 1), bisect.bisect_right(self.firsts, key)):
            if block != self.block:
                _, at, size = self.directory[block]
                self.file.seek(at)
                self.lines = [line.split("\t") for line in zlib.decompress(self.file.read(size)).decode().split("\n")]
                self.keys, self.block = [line[0] for line in self.lines], block
            for line in self.lines[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]:
                found.append((line[1], int(line[2]), int(line[3])))
        return found


def lookup(wanted: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(page_id, file, offset, size) of the captures of ``wanted`` (url, page_id).

    The index files' key ranges (one row a file) send each key to its file; a task opens the files it has
    keys for in turn and reads the blocks it needs, once each as keys come sorted. A page_id that was
    captured under several equal keys gives each capture once.
    """
    bounds = sorted((r["first"], r["last"], r["file"]) for r in files.collect())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lasts = [b[1] for b in bounds]
        for batch in batches:
            keys = [sort_key(u, p) for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            at = []
            for k in keys:
                i = bisect.bisect_left(lasts, k)
                at.append([j for j in range(i, len(bounds)) if bounds[j][0] <= k <= bounds[j][1]] if i < len(bounds) and bounds[i][1] == k else [i] if i < len(bounds) and bounds[i][0] <= k else [])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(keys, pa.string()), pa.array(at, pa.list_(pa.int32()))], ["page_id", "key", "at"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, now = None, None
        for batch in batches:
            pages, rows = [], []
            for i, (key, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if at != now:
                    index, now = IndexFile(folder, bounds[at][2]), at
                for capture in index.find(key):
                    pages.append(i)
                    rows.append(capture)
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pages, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)]], ["page_id", "file", "offset", "size"])

    kind = wanted.schema["page_id"].dataType.simpleString()
    keys = wanted.select("url", "page_id").distinct().mapInArrow(place, f"page_id {kind}, key string, at array<int>").select("page_id", "key", F.explode("at").alias("at"))
    parts = max(1, -(-wanted.count() // LOOKUPS))  # by the work: adaptive execution would see a few bytes a key
    ranged = keys.repartitionByRange(parts, "key").sortWithinPartitions("at", "key")
    return ranged.mapInArrow(search, f"page_id {kind}, file string, offset long, size long")


def read_captures(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Range-read the captures and parse them: (page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    Captures are dealt by file and offset, so that a task reads its part of an archive front to back, taking
    neighbours in one range.
    """
    bounded_batches(captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        file, now, data, begin = None, None, b"", 0
        for batch in batches:
            rows = []
            places = list(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True))
            for i, (name, offset, size) in enumerate(places):
                if name != now:
                    if file is not None:
                        file.close()
                    file, now, data, begin = store.open_input_file(f"{root}/{name}"), name, b"", 0
                if not begin <= offset <= offset + size <= begin + len(data):
                    end = offset + size
                    for other, o, s in places[i + 1 :]:
                        if other != name or o > end + GAP or o + s - offset > READ:
                            break
                        end = max(end, o + s)
                    file.seek(offset)
                    data, begin = file.read(end - offset), offset
                fields, full, payload = read_record(data[offset - begin : offset - begin + size])
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                refers = _page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                rows.append((_page_of(fields["WARC-Record-ID"]), full, digest, fields["WARC-Type"], refers, payload if with_payload else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            page = batch.schema.field(0).type
            if list(cols[0]) != batch.column(0).to_pylist():
                raise ArchiveError("a capture holds another page")
            arrays = [pa.array(c, k) for c, k in zip(cols, (page, pa.int64(), pa.string(), pa.string(), page, pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    kind = captures.schema["page_id"].dataType.simpleString()
    captures = materialise(captures, "captures")
    stored = captures.agg(F.sum("size")).first()[0] or 0
    ranged = captures.repartitionByRange(max(1, -(-stored // PART)), "file", "offset").sortWithinPartitions("file", "offset")
    out = ranged.mapInArrow(run, f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary")
    return out if with_payload else out.drop("payload")


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame, str]:
    """Write every page and the index over the archives: (captures, index files, folder)."""
    spark = pages.sparkSession
    folder = archive_uri(spark, scratch_path(spark, "warc"))
    captures = write_archives(mark_revisits(pages, page_id, url, html), folder)
    return captures, write_index(captures, folder), folder


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive every page, then look every page up in the index and read its record back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to), a row a page. Null html is an empty payload;
    a null or odd URL is kept under a key of its own form; pages that repeat an id have a record each, and a null id
    is the smallest of its group; an empty table gives an empty result; other columns are ignored.
    """
    captures, files, folder = archive(pages, page_id, url, html)
    wanted = pages.select(F.col(url).cast("string").alias("url"), F.col(page_id).alias("page_id"))
    found = lookup(wanted, files, folder)
    return read_captures(found, folder)
