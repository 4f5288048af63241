"""Text of PDF files: pages as blocks of lines, read with the standard library.

What is read: plain and Flate streams, object streams, fonts with a ToUnicode map or one byte a character (Latin-1). What isn't:
encrypted files, other filters, text in images, rotated text's order, tables' rules. Such files give what can be read, or a status row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from papyra.operators import invariants

SCHEMA = "path string, status string, page int, block int, x0 double, y0 double, size double, text string"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()%]*|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b"", b"\r": b""}
#: Lines of one block lie at most so many times their size apart.
LEADING = 1.8


class Pdf:
    """The objects of a file, by number."""

    def __init__(self, data: bytes) -> None:
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("an encrypted file")
        self.objects = {int(n): body for n, body in _OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:400]:
                self._unpack(body)
        if not self.objects:
            raise ValueError("no objects")

    def _unpack(self, body: bytes) -> None:
        count, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))  # type: ignore[index]
        data = self.stream(body)
        head = list(map(int, data[:first].split()))[: 2 * count]
        starts = [*head[1::2], len(data) - first]
        for k, n in enumerate(head[::2]):
            self.objects.setdefault(n, data[first + starts[k] : first + starts[k + 1]])

    def stream(self, body: bytes) -> bytes:
        found = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not found:
            return b""
        head = body[: found.start()]
        if b"/FlateDecode" in head:
            return zlib.decompressobj().decompress(found[1])
        return b"" if b"/Filter" in head else found[1]

    def value(self, body: bytes, name: bytes) -> bytes:
        """What stands under a name in a dictionary: a reference's object, or the dictionary or array itself."""
        found = re.search(rb"/%s(?![A-Za-z])\s*" % name, body)
        if not found:
            return b""
        rest = body[found.end() :]
        ref = re.match(_REF, rest)
        if ref:
            return self.objects.get(int(ref[1]), b"")
        opening = {b"<<": b">>", b"[": b"]"}
        for a, b in opening.items():
            if rest.startswith(a):
                depth = 0
                for m in re.finditer(re.escape(a) + b"|" + re.escape(b), rest):
                    depth += 1 if m[0] == a else -1
                    if not depth:
                        return rest[: m.end()]
        return rest.split(b"/", 1)[0]

    def pages(self) -> Iterator[tuple[bytes, bytes]]:
        """Each page's dictionary and its resources, in order; nodes are visited once."""
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)]
        left = [(self.value(b, b"Pages"), b"") for b in roots]
        seen: set[bytes] = set()
        while left:
            node, inherited = left.pop()
            if node in seen and b"/Kids" in node:
                continue
            seen.add(node)
            own = self.value(node, b"Resources") or inherited
            if b"/Kids" in node:
                kids = [self.objects.get(int(n), b"") for n in _REF.findall(self.value(node, b"Kids"))]
                left += [(k, own) for k in reversed(kids)]
            elif node:
                yield node, own

    def contents(self, page: bytes) -> bytes:
        found = self.value(page, b"Contents")
        parts = [self.objects.get(int(n), b"") for n in _REF.findall(found)] if found.lstrip().startswith(b"[") else [found]
        return b"\n".join(map(self.stream, parts))

    def fonts(self, resources: bytes) -> dict[bytes, dict[int, str] | None]:
        """Name to the map of its codes; None for fonts of one byte a character."""
        listed = self.value(resources, b"Font")
        out: dict[bytes, dict[int, str] | None] = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed):
            cmap = self.stream(self.value(self.objects.get(int(n), b""), b"ToUnicode"))
            out[name] = unicode_map(cmap) if cmap else None
        return out


def _utf16(code: bytes) -> str:
    return bytes.fromhex(re.sub(rb"\s", b"", code).decode()).decode("utf-16-be", "replace")


def unicode_map(cmap: bytes) -> dict[int, str]:
    """Codes of a ToUnicode map, single ones and ranges; the length of a code is under -1."""
    out: dict[int, str] = {}
    width = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out.update((int(a, 16), _utf16(b)) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", part))
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", part):
            first = _utf16(to)
            for k in range(min(int(b, 16) - int(a, 16), 0xFFFF) + 1):
                out[int(a, 16) + k] = first[:-1] + chr(ord(first[-1]) + k)
    return out | {-1: len(width[1]) // 2 if width else 1}  # type: ignore[dict-item]


def _shown(token: bytes, font: dict[int, str] | None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: _PLAIN.get(m[1], bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), token[1:-1])
    if font is None:
        return raw.decode("latin-1")
    n = int(font[-1])
    return "".join(font.get(int.from_bytes(raw[i : i + n], "big"), "") for i in range(0, len(raw), n))


def spans(content: bytes, fonts: dict[bytes, dict[int, str] | None]) -> Iterator[tuple[float, float, float, str]]:
    """(x, y, size, text) of each piece of text that a page shows, y from the bottom."""
    args: list[bytes] = []
    x = y = lead = 0.0
    size, scale, font = 1.0, 1.0, None

    def number(i: int) -> float:
        return float(args[i]) if len(args) >= -i and re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", args[i]) else 0.0

    for token in _TOKEN.findall(content):
        if not re.fullmatch(rb"[A-Za-z'\"*]+", token):
            args.append(token)
            continue
        if token == b"BT":
            x = y = 0.0
        elif token == b"Tf":
            size, font = number(-1), fonts.get(args[-2][1:]) if len(args) > 1 else None
        elif token == b"TL":
            lead = number(-1)
        elif token == b"Tm":
            x, y, scale = number(-2), number(-1), abs(number(-3)) or 1.0
        elif token in (b"Td", b"TD"):
            x, y = x + number(-2) * scale, y + number(-1) * scale
            lead = -number(-1) if token == b"TD" else lead
        elif token in (b"T*", b"'", b'"'):
            y -= lead * scale
        if token in (b"Tj", b"TJ", b"'", b'"'):
            # In an array a number is a gap, in thousandths; a wide one is a blank.
            text = "".join(_shown(a, font) if a[:1] in (b"(", b"<") else " " if a[:1] == b"-" and number_of(a) < -200 else "" for a in args)
            if text:
                yield x, y, size * scale, text
        args = []


def number_of(token: bytes) -> float:
    try:
        return float(token)
    except ValueError:
        return 0.0


def blocks(content: bytes, fonts: dict[bytes, dict[int, str] | None]) -> Iterator[tuple[float, float, float, str]]:
    """(x, y, size, text) of a page's blocks from the top: pieces on one height are a line, near lines of one size a block."""
    lines: list[list] = []
    for x, y, size, text in sorted(spans(content, fonts), key=lambda s: (-round(s[1], 1), s[0])):
        if lines and abs(lines[-1][1] - y) < 1.0:
            lines[-1][3] += text if lines[-1][3].endswith(" ") or text.startswith(" ") else " " + text
        else:
            lines.append([x, y, size, text])
    held: list | None = None
    for x, y, size, text in lines:
        if held and abs(held[2] - size) < 0.5 and held[4] - y <= LEADING * max(size, 1.0):
            held[0], held[3], held[4] = min(held[0], x), held[3] + "\n" + text.strip(), y
        else:
            if held:
                yield held[0], held[1], held[2], held[3]
            held = [x, y, size, text.strip(), y]
    if held:
        yield held[0], held[1], held[2], held[3]


def elements(data: bytes) -> Iterator[tuple]:
    """(page, block, x0, y0, size, text) of a file; pages count from 1, a page without text has one empty row."""
    pdf = Pdf(data)
    for page, (node, resources) in enumerate(pdf.pages(), 1):
        rows = [(page, i, *b) for i, b in enumerate(blocks(pdf.contents(node), pdf.fonts(resources)))]
        yield from rows or [(page, 0, None, None, None, "")]


def read_pdf(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """Blocks of every file under ``path`` whose name fits ``names``: status PARSED, or one row with PARSE_ERROR. Files are read whole, one at a time in each task."""
    kind = _parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = (batch.column(k)[i].as_py() for k in (0, 1))
                try:
                    found = [("PARSED", *x) for x in elements(content)] or [("PARSE_ERROR", *[None] * 6)]
                except (ValueError, TypeError, zlib.error, IndexError, RecursionError, OverflowError):
                    found = [("PARSE_ERROR", *[None] * 6)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((name, *x) for x in found), strict=True), arrow, strict=True)], schema=arrow)

    return spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("path", "content").mapInArrow(run, kind)


def statuses(rows: DataFrame) -> DataFrame:
    """Each file's status: PARSE_ERROR, OCR_REQUIRED if its pages have too little text, else PARSED."""
    texts = rows.groupBy("path", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: F.replace(F.coalesce(x["text"], F.lit("")), F.lit("\n"), F.lit(" "))), " ").alias("t"), F.min("status").alias("status"))
    whole = texts.groupBy(F.col("path").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n").alias("text"), F.min("status").alias("read"))
    gate = invariants.text_gate(whole)
    return whole.select("doc_id", "read").join(gate, "doc_id").select(F.col("doc_id").alias("path"), "pages", "chars", F.when(F.col("read") == "PARSE_ERROR", F.col("read")).when(F.col("status") == "OCR_REQUIRED", "OCR_REQUIRED").otherwise("PARSED").alias("status"))
