"""Token counts of sections: whole documents are encoded once, and token spans meet section spans.

Sections are the lines of a text, each with its line end (an empty text is one empty section), or named fields of a row that are
encoded together. The vocabulary's
byte lengths give every token's span; an interval join (binary search of both ends among the sections' starts) finds
the sections that it touches. The rule for a token that crosses a boundary: it counts, whole, for the section that
holds its first byte. Counts of a document's sections therefore add up to its tokens.

A null text counts as empty. Every row gets its result, repeated rows included; an empty table gives none. Of a long text a
million characters are symbols at one time. Columns other than doc_id and text, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.bpe import Bpe, encoded
from papyra.llm.common import free_names

COUNTS = "n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<bigint>"


def lines_of(raw: bytes) -> np.ndarray:
    """Where the lines of a text begin, in bytes."""
    starts = np.r_[0, np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1]
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(raw) else starts  # nothing follows the last line end


def attribute(bpe: Bpe, ids: bytes, starts: np.ndarray) -> tuple[int, int, int, list[int]]:
    """Tokens, sections, tokens over a boundary, tokens of each section; ``starts`` has the sections' first bytes, ascending."""
    ends = np.cumsum(bpe.lengths[np.frombuffer(ids, "<u4")])
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    first, last = np.searchsorted(starts, begins, "right") - 1, np.searchsorted(starts, ends - 1, "right") - 1
    return len(ends), len(starts), int((first != last).sum()), np.bincount(first, minlength=len(starts)).tolist()


def section_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """For every row of ``documents`` (doc_id, text) the tokens of the text and of its sections."""
    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    use = lambda bpe, rows, found: [attribute(bpe, x, lines_of(t.encode())) for (t,), x in zip(rows, found, strict=True)]
    return encoded(docs, tokenizer, ["text"], use, COUNTS).drop("text")


def field_counts(documents: DataFrame, tokenizer: str, fields: list[str]) -> DataFrame:
    """``documents`` with ``field_tokens``: how many tokens of the row's fields, encoded together as one text, go to each.

    The fields, null ones as empty, stand one after the other with a line end after each but the last, which belongs to the field
    before it. The rule for tokens over a boundary is as for sections.
    """
    (whole,) = free_names(documents, "_whole")
    joined = documents.withColumn(whole, F.concat_ws("\n", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields)))
    sizes = free_names(joined, *(f"_size{i}" for i in range(len(fields))))
    sized = joined.withColumns({s: F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for s, c in zip(sizes, fields, strict=True)})

    def use(bpe: Bpe, rows: list[tuple], found: list[bytes]) -> list[tuple]:
        out = []
        for (*n, _), ids in zip(rows, found, strict=True):
            starts = np.cumsum([0, *(k + 1 for k in n[:-1])])
            out.append((list(zip(fields, attribute(bpe, ids, starts)[3], strict=True)),))
        return out

    done = encoded(sized, tokenizer, [*sizes, whole], use, "field_tokens map<string,bigint>")
    return done.drop(whole, *sizes)
