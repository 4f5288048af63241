"""Text as column expressions: clean-up, the keys under which copies are equal, predicates on a fragment's shape, excerpts.

Nulls give null. White space is Unicode's, as ``(?U)\\s``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Full-width forms and the plain characters for them.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "￥"
_PLAIN = "".join(map(chr, range(0x21, 0x7F))) + "¥"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _composed(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, "NFKC")


def nfkc(text: Column) -> Column:
    """The text with compatibility forms composed (NFKC). Texts in ASCII stay in the JVM's hands."""
    composed = F.arrow_udf(_composed, "string")(text)
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(composed)


def plain(text: Column) -> Column:
    """Full-width forms as plain ones, each run of white space as one blank, trimmed; without Python, other compatibility forms stay."""
    return F.trim(F.regexp_replace(F.translate(text, _WIDE, _PLAIN), SPACE, " "))


def collapsed(text: Column) -> Column:
    """Each run of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def squeezed(text: Column) -> Column:
    """The text without any white space: the key under which wrapped copies are equal."""
    return F.regexp_replace(text, SPACE, "")


def _safe(text: Column) -> Column:
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(lines, r"[\x00-\x08\x0b-\x1f\x7f]", "")


def normalized(text: Column) -> Column:
    """Lines end in ``\\n``, other control characters go, blanks are single, lines trimmed, empty lines at both ends dropped."""
    single = F.regexp_replace(_safe(text), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(single, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n"), r"(?U)^\s+|\s+$", "")


def displayed(text: Column) -> Column:
    """As normalized(), but blanks and tabs stay as they are, and only line ends go at both ends."""
    return F.regexp_replace(_safe(text), r"^\n+|\n+$", "")


def key(text: Column, marks: str = "“”‘’'\"`（）()【】[]：:；;，,。.!！？?、/\\|") -> Column:
    """The text without white space and punctuation: near copies have equal keys."""
    return F.translate(squeezed(text), marks, "")


def contains_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether the text holds one of these words; false if there are none. More than a few are one pattern, which keeps plans small."""
    if len(words) > 3:
        return text.rlike("|".join(map(re.escape, words)))
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def hits(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """The words that the text holds, in the order of the list."""
    return F.array_compact(F.array(*(F.when(text.contains(w), F.lit(w)) for w in words))) if words else F.array().cast("array<string>")


# Shapes of fragments.

# Dot leaders, numerals of titles.
_LEADER = r"(?:[.]{3,}|…{2,}|．{3,})"
_NUMERAL = "0-9零〇一二三四五六七八九十百千万"


def is_navigation(text: Column) -> Column:
    """Lines of a table of contents: two dot leaders that end in a page number, or a short text full of dots."""
    dots = F.length(text) - F.length(F.translate(text, ".．…", ""))
    leaders = F.size(F.regexp_extract_all(text, F.lit(rf"({_LEADER}\s*[0-9]{{1,4}})"), F.lit(1)))
    short = (F.char_length(collapsed(text)) <= 260) & text.rlike(_LEADER) & (text.contains("…") | (dots >= 8))
    return (dots >= 3) & (short | (leaders >= 2))


def is_running_head(text: Column, tails: list[str]) -> Column:
    """A short text that ends in one of ``tails``, without a full stop near its end."""
    own = collapsed(text)
    ends = F.lit(False)
    for t in tails:
        ends = ends | own.endswith(t)
    return (F.char_length(own) <= 140) & ~F.right(own, F.lit(24)).contains("。") & ends


def is_page_number(text: Column) -> Column:
    """A page's number alone: up to three digits, or 第 N 页 with or without 共 N 页."""
    return squeezed(text).rlike(r"^(?:[0-9]{1,3}|第[0-9]+页(?:[,，]?共[0-9]+页)?)$")


def is_structural_heading(text: Column) -> Column:
    """A numbered title: 第…章 and the like, a numeral or number with a stop after it, no punctuation of sentences, at most 42 characters."""
    own = collapsed(text)
    numbered = own.rlike(rf"^(?:第[{_NUMERAL}]+[章节篇部分条]|[一二三四五六七八九十百千万]+[、.．)]|[0-9]+(?:\.[0-9]+)*[、.．)])")
    return (F.char_length(own) <= 42) & numbered & ~own.rlike("[，。；;：:,]")


def is_styled_heading(text: Column, style: Column, titles: list[str]) -> Column:
    """A heading by its paragraph style, by 第…章 as the whole text, or by one of ``titles``."""
    own, s = collapsed(text), F.lower(F.coalesce(style, F.lit("")))
    return (own != "") & (s.contains("heading") | s.startswith("标题") | own.rlike("^第[^：:]{1,30}[章节篇部分条]$") | own.isin(titles))


def is_bare_label(text: Column, operative: list[str], focus: list[str]) -> Column:
    """At most 24 characters without digits or punctuation that name a focus term but say nothing operative."""
    own = collapsed(text)
    return (own != "") & (F.char_length(own) <= 24) & ~own.rlike("[0-9。；;，,:：()（）]") & ~contains_any(own, operative) & contains_any(own, focus)


# Excerpts and locators.


def snippet(text: Column, words: list[str], limit: int = 320, lead: int = 100) -> Column:
    """At most ``limit`` characters from ``lead`` before the first word found; an ellipsis where text is left out."""

    def cut(own: Column) -> Column:
        found = F.array_min(F.filter(F.array(*(F.instr(own, w) for w in words), F.lit(0)), lambda x: x > 0))
        start = F.greatest(F.coalesce(found, F.lit(1)) - 1 - lead, F.lit(0))
        part = F.substring(own, start + 1, F.lit(limit))
        return F.when(F.char_length(own) <= limit, own).when(start > 0, F.concat(F.lit("…"), part)).otherwise(F.concat(part, F.lit("…")))

    return let(collapsed(text), cut)


def clipped(text: Column, limit: int) -> Column:
    """The text, or its first ``limit`` - 3 characters without blanks at the end and three dots."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("...")))


def locator_text(kind: Column, page: Column, block: Column, table: Column, row: Column, col: Column) -> Column:
    """A locator for people: pages count from 1, everything else from 0 in the data and from 1 in the text."""
    one = lambda c: (c + 1).cast("string")
    cell = F.concat(F.lit("table "), one(table), F.lit(", row "), one(row), F.lit(", cell "), one(col))
    return (
        F.when(kind == "pdf_block", F.concat(F.lit("page "), page.cast("string"), F.lit(", block "), one(block)))
        .when(kind == "pdf_table_cell", F.concat(F.lit("page "), page.cast("string"), F.lit(", "), cell))
        .when(kind == "docx_paragraph", F.concat(F.lit("paragraph "), one(block)))
        .when(kind == "docx_table_cell", cell)
    )


def locator_key(*columns: str) -> Column:
    """A locator as one key: its fields as JSON, in this order, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


#: Forms of a number before a heading or item, and their family; the first that fits counts.
NUMBERS = (
    ("chapter", rf"第\s*[{_NUMERAL}]+\s*[章节篇部分条]"),
    ("bracket", rf"[（(]\s*[{_NUMERAL}]+\s*[）)]"),
    ("decimal", r"[0-9]+(?:\.[0-9]+)+"),
    ("chinese", r"[一二三四五六七八九十百]+[、.．]"),
    ("arabic", r"[0-9]{1,3}[、.．)）]"),
)


def number_token(text: Column) -> Column:
    """A leading number: its family, the number itself, its level (dots and one) and the text after it. Null without one."""
    found = [(f, F.regexp_extract(text, rf"(?U)^\s*({p})", 1)) for f, p in NUMBERS]
    family, mark = F.lit(None).cast("string"), F.lit("")
    for f, x in reversed(found):
        family, mark = F.when(x != "", F.lit(f)).otherwise(family), F.when(x != "", x).otherwise(mark)
    level = F.when(family == "decimal", F.length(mark) - F.length(F.translate(mark, ".", "")) + 1).otherwise(1)
    rest = F.regexp_replace(F.substring(F.ltrim(text), F.char_length(mark) + 1, F.lit(1 << 30)), r"(?U)^\s+", "")
    return F.when(family.isNotNull(), F.struct(family.alias("family"), mark.alias("mark"), level.cast("int").alias("level"), rest.alias("rest")))
