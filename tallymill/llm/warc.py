"""WARC archives with a two-level capture index.

``write_archives`` writes real ``.warc.gz`` files (one gzip member a record, so
a byte range is a record) to the shared folder, through ``pyarrow.fs``. Each
task attempt writes under names of its own and returns where its records are;
only files of attempts that Spark accepted are ever named in the index, so a
lost executor costs a retry and leaves no wrong record.

``build_index`` sorts the captures by reversed-host key into compressed blocks
in index files and keeps a sparse directory: each block's first key, file,
offset and length. The directory has at most ``DIRECTORY`` rows (blocks grow
instead), so it may be broadcast. ``Reader.find`` is binary search in the
directory, one range read of a block, binary search in the block, and one
range read of the record.

Of equal payloads of ``REVISIT_BYTES`` bytes or more the smallest ``page_id`` is
the response; the others are revisit records without payload that refer to it.
``read_back`` goes through the index block by block; a revisit is resolved, as
a replay would, by a lookup of the response it names.

Defined results: null html is an empty payload; a null url has an empty key;
null ids never are the response another record refers to unless alone; rows
that repeat an id each are a record (those equal to the response's id and
payload are responses); other columns are not read; an empty table makes an
empty index.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.common import materialize, scratch_path

REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
BLOCK = 512
DIRECTORY = 100_000
#: Groups of copies up to this size are broadcast to the writers, more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"


def capture_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then the rest: ``com,example)/path``."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    cut = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + path.replace("\n", "%0A").replace("\r", "%0D")


def _header(value: object) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One WARC record, not compressed; a revisit where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{sha256(payload).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", refers_url))
    fields.append(("Content-Length", len(block)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_header(v)}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class Record(NamedTuple):
    kind: str
    page_id: int | None
    url: str | None
    refers_to: int | None
    refers_url: str | None
    digest: str
    payload: bytes


def parse_record(raw: bytes) -> Record:
    """A record as read; checks the digest of a response's payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(field["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda s: None if s is None or s == "<urn:page:None>" else int(s[len("<urn:page:") : -1])
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    if field["WARC-Type"] == "response" and sha256(payload).hexdigest() != digest:
        raise ValueError("payload differs from its digest")
    return Record(field["WARC-Type"], number(field["WARC-Record-ID"]), field.get("WARC-Target-URI"), number(field.get("WARC-Refers-To")), field.get("WARC-Refers-To-Target-URI"), digest, payload)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; the captures ``(key, page, archive, offset, length)``."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= REVISIT_BYTES)
    first = large.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1 and first is not null").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "copies")
    known = first.agg(F.sum(F.lit(200) + F.coalesce(F.length("first_url"), F.lit(0)))).first()[0] or 0
    paired = rows.join(F.broadcast(first) if known <= BROADCAST_BYTES else first, "digest", "left")
    # large payloads only: shorter ones have no row in ``first`` (equal digests have equal lengths)
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    ready = paired.select("page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, name, at, number = None, "", 0, 0
        try:
            for batch in batches:
                found = []
                for page, url, text, refers, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                        out, at, number = store.open_output_stream(f"{base}/{name}", compression=None), 0, number + 1
                    zipper = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = zipper.compress(make_record(page, url, text.encode(), refers, refers_url)) + zipper.flush()
                    out.write(member)
                    found.append((capture_key(url), page, name, at, len(member)))
                    at += len(member)
                    if at >= archive_bytes:
                        out.close()
                        out = None
                if found:
                    key, page, archive, offset, length = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(page, pa.int64()), pa.array(archive), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["key", "page", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return materialize(ready.mapInArrow(run, "key string, page long, archive string, offset long, length long"), "captures")


def _entry(key: str, page: int | None) -> tuple[str, int]:
    """Order of captures: key, then page; null pages first."""
    return key, -(1 << 63) if page is None else page


class Index(NamedTuple):
    """Where the archives and the blocks are, and the directory:
    ``(first key, first page, file, offset, length)`` of each block, in order."""

    folder: str
    directory: list[tuple[str, int, str, int, int]]


def build_index(captures: DataFrame, folder: str, block: int = BLOCK, directory: int = DIRECTORY) -> Index:
    """Sorts the captures into blocks. At most about ``directory`` rows, two a
    partition more, come to the driver."""
    total = captures.count()
    size = max(block, -(-total // directory))
    ordered = captures.repartitionByRange("key", "page", "archive", "offset").sortWithinPartitions("key", "page", "archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = _open(folder)
        name, at, out, held = f"{task.partitionId():06d}-{task.taskAttemptId()}.cdx.gz", 0, None, []

        def flush() -> pa.RecordBatch:
            nonlocal at, out, held
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = zipper.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in held).encode()) + zipper.flush()
            out.write(member)
            key, page = _entry(held[0][0], held[0][1])
            row = pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, page, name, at, len(member))], names=["key", "page", "file", "offset", "length"])
            at, held = at + len(member), []
            return row

        try:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    held.append(row)
                    if len(held) == size:
                        yield flush()
            if held:
                yield flush()
        finally:
            if out is not None:
                out.close()

    blocks = materialize(ordered.mapInArrow(run, "key string, page long, file string, offset long, length long"), "directory")
    return Index(folder, sorted((r.key, r.page, r.file, r.offset, r.length) for r in blocks.collect()))


class Reader:
    """Range reads through an index; keeps a few files and blocks open."""

    def __init__(self, index: Index):
        self.index = index
        self.store, self.base = _open(index.folder)
        self.starts = [(k, p) for k, p, *_ in index.directory]
        self.files: OrderedDict[str, object] = OrderedDict()
        self.blocks: OrderedDict[int, list] = OrderedDict()

    def range(self, name: str, offset: int, length: int) -> bytes:
        """Inflated bytes of one gzip member."""
        if name not in self.files:
            self.files[name] = self.store.open_input_file(f"{self.base}/{name}")
            if len(self.files) > 16:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(name)
        f = self.files[name]
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)

    def block(self, number: int) -> list:
        """Captures ``[key, page, archive, offset, length]`` of one block."""
        if number not in self.blocks:
            _, _, name, offset, length = self.index.directory[number]
            self.blocks[number] = [json.loads(line) for line in self.range(name, offset, length).decode().split("\n")]
            if len(self.blocks) > 8:
                self.blocks.popitem(last=False)
        return self.blocks[number]

    def find(self, key: str, page: int | None) -> Record | None:
        """The first capture of a key and page."""
        want = _entry(key, page)
        # equal captures may begin in the block before the first start that is not smaller
        at = max(0, bisect_left(self.starts, want) - 1)
        while at < len(self.starts) and self.starts[at] <= want:
            rows = self.block(at)
            k = bisect_left(rows, want, key=lambda r: _entry(r[0], r[1]))
            if k < len(rows):
                return self.record(rows[k]) if _entry(rows[k][0], rows[k][1]) == want else None
            at += 1
        return None

    def captures(self, key: str) -> Iterator[list]:
        """All captures of a key, in order of page."""
        at = max(0, bisect_left(self.starts, (key, -(1 << 63))) - 1)
        stop = bisect_right(self.starts, (key, 1 << 63))
        for number in range(at, stop):
            rows = self.block(number)
            yield from rows[bisect_left(rows, key, key=lambda r: r[0]) : bisect_right(rows, key, key=lambda r: r[0])]

    def record(self, capture: list) -> Record:
        return parse_record(self.range(*capture[2:5]))


def read_back(spark: SparkSession, index: Index) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every
    record, read by its range; each block is one row to deal out."""
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        known: OrderedDict[tuple, tuple[int, str]] = OrderedDict()
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rows = []
                for capture in reader.block(number):
                    r = reader.record(capture)
                    size, digest = len(r.payload), r.digest
                    if r.kind == "revisit":
                        at = (capture_key(r.refers_url), r.refers_to)
                        if at not in known:
                            target = reader.find(*at)
                            # ids that repeat may put another payload first; the revisit's own header then stands
                            same = target is not None and target.kind == "response" and target.digest == r.digest
                            known[at] = (len(target.payload), target.digest) if same else None
                            if len(known) > 4096:
                                known.popitem(last=False)
                        size, digest = known[at] if known[at] and known[at][1] == r.digest else (declared_length(reader, capture), r.digest)
                    rows.append((r.page_id, size, digest, r.kind, r.refers_to))
                page, size, digest, kind, refers = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array(kind), pa.array(refers, pa.int64())],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    parts = max(1, min(len(index.directory), 4 * spark.sparkContext.defaultParallelism, 100_000))
    numbers = spark.range(0, len(index.directory), 1, parts)
    return numbers.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def declared_length(reader: Reader, capture: list) -> int:
    """Payload length that the HTTP header of a record declares."""
    raw = reader.range(*capture[2:5])
    http = raw.split(b"\r\n\r\n", 2)[1]
    return int(http.rpartition(b"Content-Length: ")[2])


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, block: int = BLOCK) -> Index:
    """Archives and index of ``pages`` in ``folder`` (else in the shared folder)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return build_index(write_archives(pages, folder, id_col, url_col, html_col), folder, block)
