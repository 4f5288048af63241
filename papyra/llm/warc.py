"""WARC archives with a two-level capture index.

Executors write archives (``*.warc.gz``, a gzip member for each record) into a folder that all of them reach. Captures
are sorted by their URL with the host reversed (then page_id) and stored as compressed blocks of ``BLOCK`` lines, a gzip
member each; a sparse directory keeps the first and last key, file, offset and length of every block, by the part of the
key range that its task had. A search goes by binary search three times: among the parts (one row a task), among a part's blocks in
the directory, and among a block's lines. What it finds are places in archives; these are sorted, and near ones are read
at once.

Of records with equal payloads of at least ``MIN_BYTES`` bytes the one with the largest page_id is a response and the
others are revisits of it. Null html is an empty payload, a null url a record without target. Repeated rows with the
largest page_id are all responses; a row without page_id is a revisit if a row with one has its payload. An empty table gives
archives without files. A payload is in memory whole, with its record, as a page is in its row. Columns other than page_id, url
and html, whatever their names, are left out. A task that is tried again writes new files; only files that the captures name
count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import Any
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from papyra.llm.common import partitions, written

MIN_BYTES = 1000
#: Captures of a block; bytes at which an archive is closed and the next begun.
BLOCK, ARCHIVE_BYTES = 512, 1 << 30
#: Ranges of an archive this near to each other are read at once, up to so many bytes; archives are dealt out in stripes.
GAP, SPAN, STRIPE = 64 << 10, 8 << 20, 64 << 20
DATE = "2024-01-01T00:00:00Z"
CAPTURES = "surt string, page_id bigint, file string, offset bigint, length bigint"
DIRECTORY = "part int, first string, last string, file string, offset bigint, length bigint, captures int"
PLACES = "file string, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """The URL as a sort key: host reversed, then port, path and query; the scheme, user and fragment go."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return re.sub(r"[\t\r\n]", " ", url or "")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"[\t\r\n]", " ", key)


def squeezed(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def opened(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record; a revisit has the HTTP head without the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    own = f"urn:papyra:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))) + " ")))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:papyra:page:{refers_to}>")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:papyra:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def parsed(data: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes | None]:
    """page_id, url, bytes and digest of the full payload, type, what it refers to, the payload (none for revisits)."""
    from urllib.parse import unquote

    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(field["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])  # type: ignore[index]
    if field["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload and digest differ")
    url = field.get("warc-target-uri")
    return _page(field["warc-record-id"]), unquote(url) if url is not None else None, size, digest, field["warc-type"], _page(field.get("warc-refers-to")), payload if field["warc-type"] == "response" else None


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that Hadoop names, and the path in it."""
    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest)


class Out:
    """A file in the shared folder that pieces are appended to; it takes its name when it is complete."""

    def __init__(self, folder: str, kind: str) -> None:
        self.store, path = store_of(folder)
        self.store.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.{kind}.gz"
        self.path, self.size = f"{path}/{self.name}", 0
        self.stream = self.store.open_output_stream(self.path + ".part", compression=None)

    def add(self, data: bytes) -> tuple[int, int]:
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at, len(data)

    def close(self) -> None:
        self.stream.close()
        self.store.move(self.path + ".part", self.path)


class In:
    """Ranges of the files of a folder; a file is opened once."""

    def __init__(self, folder: str) -> None:
        self.store, self.path = store_of(folder)
        self.name, self.file = "", None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.store.open_input_file(f"{self.path}/{name}")
        self.file.seek(offset)  # type: ignore[union-attr]
        return self.file.read(length)  # type: ignore[union-attr]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def table(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def rows_of(batches: Iterable[pa.RecordBatch], size: int = 64) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns), strict=True)


class Archive:
    """Archives and index in a folder: ``directory`` is a table, the rest are files."""

    def __init__(self, spark: SparkSession, folder: str, directory: DataFrame) -> None:
        self.spark, self.folder, self.directory = spark, folder, directory

    @classmethod
    def write(cls, pages: DataFrame, folder: str, *, min_bytes: int = MIN_BYTES) -> Archive:
        """Archives and indexes every row of ``pages`` (page_id, url, html)."""
        spark = pages.sparkSession
        html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
        own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
        own = own.withColumn("digest", F.sha1("payload"))
        # Payloads that come again, as a table: its size decides how it is joined.
        again = own.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
        joined = own.join(written(again, "again"), "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
        kind, arrow = T._parse_datatype_string(CAPTURES), to_arrow_schema(T._parse_datatype_string(CAPTURES))

        def archive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, rows = None, []
            for page_id, url, payload, digest, refers_to in rows_of(batches):
                out = out or Out(folder, "warc")
                rows.append((surt(url), page_id, out.name, *out.add(squeezed(record(page_id, url, payload, digest, refers_to)))))
                if out.size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                if len(rows) >= 4096:  # the file is complete before the task is
                    yield table(rows, arrow)
                    rows = []
            if out:
                out.close()
            if rows:
                yield table(rows, arrow)

        captures = written(joined.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(archive, kind), "captures")
        entry, held = T._parse_datatype_string(DIRECTORY), to_arrow_schema(T._parse_datatype_string(DIRECTORY))

        def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, block, rows, part = None, [], [], TaskContext.get().partitionId()  # type: ignore[union-attr]

            def close() -> None:
                data = "".join("\t".join("" if x is None else str(x) for x in line) + "\n" for line in block)
                rows.append((part, block[0][0], block[-1][0], out.name, *out.add(squeezed(data.encode())), len(block)))  # type: ignore[union-attr]
                block.clear()

            for line in rows_of(batches, 4096):
                out = out or Out(folder, "cdx")
                block.append(line)
                if len(block) == BLOCK:
                    close()
            if block:
                close()
            if out:
                out.close()
                yield table(rows, held)

        ordered = captures.repartitionByRange(partitions(spark), "surt", "page_id", "file", "offset").sortWithinPartitions("surt", "page_id")
        return cls(spark, folder, written(ordered.mapInArrow(index, entry), "directory"))

    def _records(self, places: DataFrame, payloads: bool) -> DataFrame:
        """The records at these places (file, offset, length) of the archives, stripe by stripe and forward in each."""
        folder, kind = self.folder, T._parse_datatype_string(RECORDS)
        arrow = to_arrow_schema(kind)

        def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            archives, rows, size = In(folder), [], 0
            for name, at, spans in runs_of(rows_of(batches, 4096)):
                data = archives.read(name, at, spans[-1][0] + spans[-1][1] - at)
                for start, n in spans:
                    *found, payload = parsed(opened(data[start - at : start - at + n]))
                    rows.append((*found, payload if payloads else None))
                    size += len(payload or b"") if payloads else 64
                    if size >= 4 << 20:
                        yield table(rows, arrow)
                        rows, size = [], 0
            if rows:
                yield table(rows, arrow)
            archives.close()

        dealt = places.repartition(partitions(self.spark), "file", F.expr(f"offset div {STRIPE}")).sortWithinPartitions("file", "offset")
        return dealt.select("file", "offset", "length").mapInArrow(read, kind)

    def _captures(self, blocks: DataFrame, by_key: bool) -> DataFrame:
        """Places in archives that blocks (file, offset, length) list: all of them, or by_key those of the ``key`` beside the block."""
        folder, kind = self.folder, T._parse_datatype_string(PLACES)
        arrow = to_arrow_schema(kind)

        def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, last, lines, order, rows = In(folder), None, [], [], []
            for file, offset, length, key in rows_of(batches, 4096):
                if (file, offset) != last:
                    last, lines = (file, offset), [x.split("\t") for x in opened(index.read(file, offset, length)).decode().split("\n")[:-1]]
                    order = [x[0] for x in lines]
                own = lines[bisect_left(order, key) : bisect_right(order, key)] if by_key else lines
                rows += [(name, int(at), int(n)) for _, _, name, at, n in own]
                if len(rows) >= 4096:
                    yield table(rows, arrow)
                    rows = []
            if rows:
                yield table(rows, arrow)
            index.close()

        keyed = blocks if by_key else blocks.withColumn("key", F.lit(""))
        dealt = keyed.repartition(partitions(self.spark), "file", "offset").sortWithinPartitions("file", "offset", "key")
        return dealt.select("file", "offset", "length", "key").mapInArrow(read, kind)

    def records(self, *, payloads: bool = False) -> DataFrame:
        """All records, read back by the index; without payloads their digests have been checked all the same."""
        return self._records(self._captures(self.directory, False), payloads)

    def find(self, urls: DataFrame, *, payloads: bool = True) -> DataFrame:
        """The records of the URLs in the one column of ``urls``, each once however often its URL comes; null counts as the empty URL.

        Only blocks that can hold one of the keys are read. The parts' bounds, a row for each task that wrote the index, are held
        on the driver and sent along; the directory and the keys meet part by part, the part's blocks first.
        """
        bounds = sorted(tuple(r) for r in self.directory.groupBy("part").agg(F.min("first").alias("a"), F.max("last").alias("b")).select("a", "b", "part").collect())
        firsts, lasts, parts = ([x[k] for x in bounds] for k in range(3))
        search_kind = T._parse_datatype_string("part int, key string")
        block_kind = T._parse_datatype_string(PLACES + ", key string")
        key_arrow, block_arrow = to_arrow_schema(search_kind), to_arrow_schema(block_kind)

        def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(parts[i], k) for k in {surt(u) for u in batch.column(0).to_pylist()} for i in holding(firsts, lasts, [k])]
                if rows:
                    yield table(rows, key_arrow)

        def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, a, b, places, rows = None, [], [], [], []
            for part, key, first, last, *place in rows_of(batches, 4096):
                if part != own:
                    own, a, b, places = part, [], [], []
                if key is None:
                    a.append(first)
                    b.append(last)
                    places.append(place)
                    continue
                rows += [(*places[i], key) for i in holding(a, b, [key])]
                if len(rows) >= 4096:
                    yield table(rows, block_arrow)
                    rows = []
            if rows:
                yield table(rows, block_arrow)

        wanted = urls.select(F.col(f"`{urls.columns[0]}`").cast("string")).distinct().mapInArrow(keys, search_kind).distinct()
        held = self.directory.select("part", F.lit(None).cast("string").alias("key"), "first", "last", "file", "offset", "length")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("first", "string"), ("last", "string"), ("file", "string"), ("offset", "bigint"), ("length", "bigint"))]
        every = held.unionByName(wanted.select("part", "key", *none))
        met = every.repartition(partitions(self.spark), "part").sortWithinPartitions("part", F.col("key").isNotNull(), "first", "last", "file", "offset")
        return self._records(self._captures(met.mapInArrow(blocks, block_kind), True), payloads)

    def lookup(self, urls: list[str], *, payloads: bool = True) -> DataFrame:
        """find() for a list."""
        return self.find(self.spark.createDataFrame([(u,) for u in urls], "url string"), payloads=payloads)


def runs_of(places: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Sorted places (file, offset, length) as file, first offset and the ranges that are read at once."""
    name, spans = "", []
    for file, at, n in places:
        if spans and (file != name or at - spans[-1][0] - spans[-1][1] > GAP or at + n - spans[0][0] > SPAN):
            yield name, spans[0][0], spans
            spans = []
        name = file
        spans.append((at, n))
    if spans:
        yield name, spans[0][0], spans


def search(firsts: list[str], key: str) -> range:
    """Places, in a sorted directory, of the blocks that can hold a key: by binary search among their first keys."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def holding(firsts: list[str], lasts: list[str], keys: list[str]) -> list[int]:
    """Places, in a sorted directory or any part of it, of the blocks whose first and last keys enclose one of ``keys``."""
    return sorted({i for k in keys for i in search(firsts, k) if lasts[i] >= k})


__all__: list[Any] = ["Archive", "parsed", "record", "search", "surt"]
