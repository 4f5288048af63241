"""DOCX files as ordered elements: paragraphs and table cells in the order of the body."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, status string, pos int, kind string, table int, row int, col int, style string, text string"


#: Elements whose text stands elsewhere: boxes that float, and the copies of them for old readers.
_ELSEWHERE = {f"{_W}txbxContent", "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"}
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}


def _text(node: ElementTree.Element) -> str:
    """The text of a paragraph; tabs and breaks as characters, floating boxes left out."""
    out, left = [], [node]
    while left:
        x = left.pop()
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag not in _ELSEWHERE:
            out.append(_MARKS.get(x.tag, ""))
            left.extend(reversed(x))
    return "".join(out)


def _grid(table: ElementTree.Element) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of every place of the table's grid: a merged cell's text stands at each of its places."""
    above: dict[int, str] = {}
    for i, row in enumerate(table.findall(f"{_W}tr")):
        skipped = row.find(f"{_W}trPr/{_W}gridBefore")
        col, now = int(skipped.get(f"{_W}val", "0")) if skipped is not None else 0, {}
        for cell in row.findall(f"{_W}tc"):
            wide, merged = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            goes_on = merged is not None and merged.get(f"{_W}val", "continue") == "continue"
            own = "\n".join(map(_text, cell.findall(f"{_W}p")))
            for _ in range(int(wide.get(f"{_W}val", "1")) if wide is not None else 1):
                now[col] = above.get(col, own) if goes_on else own
                yield i, col, now[col]
                col += 1
        above = now


def elements(content: bytes) -> Iterator[tuple]:
    """(kind, table, row, col, style, text) of each paragraph and place of a table; a cell's paragraphs are joined by newlines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    table = -1
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            yield "paragraph", None, None, None, None if style is None else style.get(f"{_W}val"), _text(node)
        elif node.tag == f"{_W}tbl":
            table += 1
            for i, j, text in _grid(node):
                yield "cell", table, i, j, None, text


def read_docx(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """Elements of every file under ``path`` whose name fits ``names`` (a file, folder or pattern that Spark reads).

    A file that can't be read gives one row with status FAILED and no text; one without text gives OCR_REQUIRED.
    Other rows are OK. Spark's reader passes over files of no bytes: these give no row. Files are read whole, one at a time in each task.
    """
    kind = _parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = (batch.column(k)[i].as_py() for k in (0, 1))
                try:
                    found = [("OK", pos, *x) for pos, x in enumerate(elements(content))]
                    if not any(x[-1].strip() for x in found):
                        found = [("OCR_REQUIRED", *[None] * 7)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, NotImplementedError, RuntimeError, EOFError, zlib.error):
                    found = [("FAILED", *[None] * 7)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((name, *x) for x in found), strict=True), arrow, strict=True)], schema=arrow)

    return spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("path", "content").mapInArrow(run, kind)


def fragments(rows: DataFrame) -> DataFrame:
    """The elements as fragments (doc_id, pos, text): lines of paragraphs, then each table's rows with cells joined by a bar."""
    read = rows.where("status = 'OK'")
    lines = read.where("kind = 'paragraph'").select(F.col("path").alias("doc_id"), F.col("pos"), F.col("text"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"])
    table = read.where("kind = 'cell'").groupBy(F.col("path").alias("doc_id"), "table", "row").agg(F.min("pos").alias("pos"), F.array_join(cells, " | ").alias("text"))
    return lines.unionByName(table.select("doc_id", "pos", "text")).where(F.trim("text") != "")
