"""Labelled values in fragments: candidates by access path, then one fact for each document and field.

A field is a name, a kind (see ``papyra.functions.values.typed``) and its labels. Fields are a short fixed list. Candidates
have doc_id, field, pos (place of the value), value, method, confidence and evidence. Rows without doc_id give candidates
that no fact takes up; null texts give none.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.functions import values
from papyra.operators import resolution


class Field(NamedTuple):
    name: str
    kind: str
    labels: tuple[str, ...]
    entity: bool = False
    multiline: bool = False


# Confidence of each access path, and what a candidate that stands alone needs to resolve its field.
CONFIDENCE = {
    "table_label": 0.98, "same_line": 0.95, "lot_value": 0.94, "multiline": 0.90, "lot_heading": 0.90, "next_line": 0.85,
    "platform": 0.80, "proposal": 0.80, "lot_title": 0.75, "keyword": 0.70, "title": 0.68,
}
GATE = {
    "table_label": 0.95, "same_line": 0.90, "lot_value": 0.92, "multiline": 0.85, "lot_heading": 0.88, "next_line": 0.85,
    "platform": 0.75, "proposal": 0.80, "lot_title": 0.72, "title": 0.65,
}
# Words that stand for no value.
ROLES = (
    "招标人", "投标人", "采购人", "供应商", "中标人", "发包人", "承包人", "委托人", "建设单位", "施工单位", "监理单位", "设计单位",
    "招标代理机构", "采购代理机构", "代理机构", "甲方", "乙方",
)
UNITS = ("日历天", "天", "日", "月", "年", "个", "项", "套", "台", "元", "万元", "人民币", "%", "％", "平方米", "立方米")
INSTRUCTIONS = ("盖章", "盖单位章", "签字", "公章", "签章", "电子印章", "加盖", "手写", "填写", "说明", "如有", "若无", "可选", "示例")
EDGES = " \t\r\n,，;；。.!！？?"
QUOTES = ("“”", '""', "''", "‘’", "「」", "『』", "（）", "()")

_QUOTED = "(?s)^(?:" + "|".join(f"{re.escape(q[0])}.*{re.escape(q[1])}" for q in QUOTES) + ")$"
_CANDIDATE = ("doc_id", "field", "pos", "value", "method", "confidence", "evidence")


def cleaned(value: Column, layers: int = 3) -> Column:
    """The value without punctuation at its edges and without matched quotes or brackets around it, up to ``layers`` of them."""
    peel = lambda x: F.trim(F.btrim(F.trim(x), F.lit(EDGES)))

    def once(v: Column) -> Column:
        return F.when(v.rlike(_QUOTED), peel(F.substring(v, F.lit(2), F.char_length(v) - 2))).otherwise(v)

    out = peel(value)
    for _ in range(layers):
        out = tx.let(out, once)
    return out


def _bare(value: Column) -> Column:
    return F.rtrim(F.btrim(value, F.lit(EDGES)), F.lit(" \t\r\n:："))


def is_blank_rule(value: Column) -> Column:
    """Only blanks, underscores, boxes or private-use glyphs: a rule to write on."""
    return F.trim(value).rlike(r"^[\s 　_＿-□☐]+$")


def is_instruction(value: Column) -> Column:
    """A short bracketed instruction, as （盖单位章）."""
    own = F.trim(value)
    return own.rlike("^[（(][^（()）]{1,24}[）)]$") & tx.contains_any(own, INSTRUCTIONS)


def is_label_list(value: Column, labels: list[str]) -> Column:
    """A single line that is a label, or several lines each of which is a label or short without digits and punctuation."""
    names = F.array(*map(F.lit, labels))
    lines = F.filter(F.transform(F.split(F.replace(value, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    bare = F.transform(lines, lambda x: F.struct(x.rlike("[:：]").alias("pair"), _bare(x).alias("t")))
    short = lambda t: (F.char_length(t) <= 12) & ~t.rlike(r"[。！？，、；0-9]")
    like = lambda x: ~x["pair"] & ((x["t"] == "") | F.array_contains(names, x["t"]) | short(x["t"]))
    return tx.let(bare, lambda b: F.when(F.size(b) == 1, F.array_contains(names, b[0]["t"])).otherwise((F.size(b) > 1) & F.forall(b, like) & F.exists(b, lambda x: x["t"] != "")))


def is_no_value(value: Column, labels: list[str], placeholders: tuple[str, ...] = ()) -> Column:
    """Whether a text is a placeholder, reference, role, unit, rule, instruction, list of labels or cut at an open bracket. Never null."""

    def test(own: Column) -> Column:
        open_ = lambda a, b: F.length(F.translate(own, a, "")) < F.length(F.translate(own, b, ""))
        said = F.rtrim(own, F.lit(":")).isin(*ROLES, *placeholders) | _bare(F.trim(value)).isin(*UNITS) | own.startswith("见")
        return (own == "") | said | open_("(", ")") | open_("（", "）") | is_blank_rule(value) | is_instruction(value) | is_label_list(value, labels)

    return F.coalesce(tx.let(tx.squeezed(tx.plain(value)), test), F.lit(True))


def is_header_block(evidence: Column, label: Column, labels: list[str]) -> Column:
    """Whether evidence is a table's head and no pair: lines that are all labels, or the label and two or more short lines without punctuation."""
    lines = F.filter(F.transform(F.split(F.replace(evidence, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    known = lambda x: F.array_contains(F.array(*map(F.lit, labels)), _bare(x))
    tail = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1)))
    short = F.forall(tail, lambda x: (F.char_length(x) <= 12) & ~x.rlike(r"[。！？，、；：0-9]"))
    pair = F.exists(lines, lambda x: x.rlike("[:：]"))
    return (F.size(lines) >= 2) & ~pair & (F.forall(lines, known) | ((_bare(lines[0]) == label) & (F.size(lines) >= 3) & short))


def entity(value: Column) -> Column:
    """The institution that a contact cell names after 名称, else the cell."""
    named = F.trim(F.regexp_extract(F.regexp_replace(value, r"\r\n?", "\n"), r"名\s*称\s*[：:]\s*([^\n]+)", 1))
    return F.when(named != "", named).otherwise(value)


def _labels(fields: list[Field]) -> str:
    """Every label as a pattern, the longest first."""
    return "|".join(re.escape(x) for x in sorted(all_labels(fields), key=len, reverse=True))


def all_labels(fields: list[Field]) -> list[str]:
    """The labels of all fields; one that two fields have tells neither apart and is left out."""
    every = [x for f in fields for x in dict.fromkeys(f.labels)]
    return [x for x in every if every.count(x) == 1]


def _field(fields: list[Field], label: Column) -> Column:
    own = set(all_labels(fields))
    pairs = [F.lit(v) for f in fields for x in f.labels if x in own for v in (x, f.name)]
    return F.element_at(F.create_map(*pairs), label)


def _of(rows: DataFrame, fields: list[Field], method: str) -> DataFrame:
    """Candidates of rows (doc_id, field, pos, value, evidence): values cleaned, entities named, what is no value left out."""
    names = [f.name for f in fields if f.entity]
    value = F.when(F.col("field").isin(names), entity(F.col("value"))).otherwise(F.col("value")) if names else F.col("value")
    told = ~(F.coalesce(is_instruction(F.col("value")) | is_blank_rule(F.col("value")), F.lit(True)))
    out = rows.where("field is not null").where(told).withColumn("value", cleaned(value)).where(~is_no_value(F.col("value"), all_labels(fields)))
    return out.withColumns({"method": F.lit(method), "confidence": F.lit(CONFIDENCE[method])}).select(*_CANDIDATE)


def table_label(cells: DataFrame, fields: list[Field], reach: int = 3) -> DataFrame:
    """A cell that is a label, and the first cell with text among the next ``reach`` of its row, unless that is a label.

    ``cells`` has doc_id, table, row, col, pos, text. The evidence is the row.
    """
    row = Window.partitionBy("doc_id", "table", "row").orderBy("col")
    whole = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = F.array(*(F.struct(F.lead("pos", i).over(row).alias("pos"), F.lead("text", i).over(row).alias("text")) for i in range(1, reach + 1)))
    named = lambda c: _bare(tx.plain(c))
    found = cells.withColumns({"label": named(F.col("text")), "next": F.get(F.filter(ahead, lambda x: tx.plain(x["text"]) != ""), F.lit(0)), "evidence": F.array_join(F.filter(F.transform(F.collect_list("text").over(whole), lambda x: F.trim(x)), lambda x: x != ""), " | ")})
    found = found.where(F.col("label").isin(all_labels(fields)) & F.col("next").isNotNull() & ~named(F.col("next.text")).isin(all_labels(fields)))
    return _of(found.select("doc_id", _field(fields, F.col("label")).alias("field"), F.col("next.pos").alias("pos"), F.col("next.text").alias("value"), "evidence"), fields, "table_label")


def same_line(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """``label: value`` in one fragment, the value up to the next label or the end."""
    label = _labels(fields)
    pattern = F.lit(rf"(?U)({label})\s*[:：]\s*(.*?)\s*(?=(?:{label})\s*[:：]|$)")
    found = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("label"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("value"))
    each = rows.select("doc_id", "pos", "text", F.explode(found).alias("x"))
    return _of(each.select("doc_id", _field(fields, F.col("x.label")).alias("field"), "pos", F.col("x.value").alias("value"), F.col("text").alias("evidence")), fields, "same_line")


def _begins_with_label(text: Column, fields: list[Field]) -> Column:
    return text.rlike(rf"(?U)^\s*(?:{_labels(fields)})\s*(?:[:：]|$)")


def next_line(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """A fragment that is only a label, and the next one unless it begins with a label, is a heading or a table's cell."""
    own = F.regexp_extract("text", rf"(?U)^\s*({_labels(fields)})\s*[:：]?\s*$", 1)
    kind = F.col("kind") if "kind" in rows.columns else F.lit("paragraph")
    order = Window.partitionBy("doc_id").orderBy("pos")
    lead = lambda c: F.lead(c).over(order)
    each = rows.withColumn("kind", kind).select("doc_id", "text", own.alias("label"), lead(F.col("pos")).alias("pos"), lead(F.col("text")).alias("value"), lead(F.col("kind")).alias("then"), "kind")
    each = each.where("label != '' and kind != 'cell' and then != 'cell'").where(~_begins_with_label(F.col("value"), fields) & ~tx.is_styled_heading(F.col("value"), F.lit(None).cast("string"), []))
    return _of(each.select("doc_id", _field(fields, F.col("label")).alias("field"), "pos", "value", F.concat_ws("\n", F.trim("text"), F.trim("value")).alias("evidence")), fields, "next_line")


def multiline(rows: DataFrame, fields: list[Field], most: int = 3) -> DataFrame:
    """A label of a ``multiline`` field and the parts of its value: what follows on its line, then the lines up to a label or heading, ``most`` in all.

    A value that the label's line holds alone belongs to same_line() and gives nothing here.
    """
    wide = [f for f in fields if f.multiline]
    order = Window.partitionBy("doc_id").orderBy("pos")
    ahead = F.array(*(F.lead("text", i).over(order) for i in range(1, most + 1)))
    pattern = rf"(?Us)^\s*({_labels(wide)})\s*(?:[:：]\s*(.*))?$"
    each = rows.select("doc_id", "pos", "text", F.regexp_extract("text", pattern, 1).alias("label"), F.trim(F.regexp_extract("text", pattern, 2)).alias("tail"), ahead.alias("ahead")).where("label != ''")
    stops = lambda x: x.isNull() | _begins_with_label(x, fields) | tx.is_structural_heading(x)
    first_stop = F.array_position(F.transform(F.col("ahead"), lambda x: F.coalesce(stops(x), F.lit(True))), F.lit(True)).cast("int")
    free = F.when(first_stop == 0, F.lit(most)).otherwise(first_stop - 1)
    parts = F.slice(F.concat(F.filter(F.array("tail"), lambda x: x != ""), F.slice("ahead", F.lit(1), free)), 1, most)
    each = each.withColumn("parts", parts).where((F.size("parts") >= 1) & ~((F.col("tail") != "") & (F.size("parts") == 1)))
    value = F.array_join(F.transform("parts", lambda x: F.regexp_replace(cleaned(x), "^名称[：:]", "")), "")
    return _of(each.select("doc_id", _field(fields, F.col("label")).alias("field"), "pos", value.alias("value"), F.array_join(F.concat(F.array("text"), "parts"), "\n").alias("evidence")), fields, "multiline")


def keyword(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """``label`` 为, 是, 包括 or 指 and what follows up to punctuation; for yes_no fields, words that grant or deny before the label."""
    label = _labels(fields)
    says = rf"({label})\s*(?:为|是|包括|指(?!定))\s*([^\n，,。；;、]+)"
    grants = rf"(?<![是否])({'|'.join(sorted({*values.NO, *values.YES, '不可以'}, key=len, reverse=True))})\s*({label})"
    pairs = lambda p, i, j: F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(i)).alias("label"), F.regexp_extract_all("text", F.lit(p), F.lit(j)).alias("value"))
    own = rows.select("doc_id", "pos", "text", F.explode(pairs(says, 1, 2)).alias("x"))
    asked = [f.name for f in fields if f.kind == "yes_no"]
    each = lambda df: df.select("doc_id", _field(fields, F.col("x.label")).alias("field"), "pos", F.col("x.value").alias("value"), F.col("text").alias("evidence"))
    out = each(own)
    if asked:
        out = out.unionByName(each(rows.select("doc_id", "pos", "text", F.explode(pairs(grants, 2, 1)).alias("x"))).where(F.col("field").isin(asked)))
    return _of(out, fields, "keyword")


def title(rows: DataFrame, field: Field, endings: tuple[str, ...], never: tuple[str, ...], pages: int = 3) -> DataFrame:
    """Fragments of 8 to 120 characters on the first pages that end as titles do, without punctuation of sentences and words of clauses."""
    own = tx.squeezed(tx.plain(F.col("text")))
    ends = reduce(lambda a, b: a | b, (own.endswith(e) for e in endings))
    page = F.col("page") if "page" in rows.columns else F.lit(1)
    found = rows.where(F.char_length(own).between(8, 120) & ~F.col("text").contains("\n") & (F.coalesce(page, F.lit(1)) <= pages) & ~own.rlike("[：:。；;，,]") & ~tx.is_structural_heading(own) & ~tx.contains_any(own, never) & ends)
    return _of(found.select("doc_id", F.lit(field.name).alias("field"), "pos", own.alias("value"), F.col("text").alias("evidence")), [field], "title")


# Fixed value: how a lot is named.
_LOT = "(?<![同每各])(?:第[一二三四五六七八九十百零〇0-9]{1,3}标段|[一二三四五六七八九十百零〇0-9]{1,3}标段)"


def lots(rows: DataFrame, field: Field, value_labels: tuple[str, ...], headings: tuple[str, ...], name_labels: tuple[str, ...], pages: int = 3) -> DataFrame:
    """The lot that a document belongs to: after the label of an amount, before a heading's words, or alone on a first page that names the project.

    The page test is a window over (doc_id, page). ``rows`` has doc_id, page, pos, text.
    """
    own = tx.squeezed(tx.plain(F.col("text")))
    tidy = lambda x: F.regexp_replace(x, "^[0-9]+(?=[一二三四五六七八九十百零〇]标段$)", "")
    names = own.rlike(rf"(?:{'|'.join(name_labels)})[:：]")
    on_page = F.bool_or(names).over(Window.partitionBy("doc_id", "page"))
    paths = {
        "lot_value": F.regexp_extract(own, rf"(?:{'|'.join(value_labels)})[为是]?[:：]?({_LOT})", 1),
        "lot_heading": F.regexp_extract(own, rf"({_LOT})(?:{'|'.join(headings)})", 1),
        "lot_title": F.when(F.col("named") & (F.col("page") <= pages), F.regexp_extract(own, rf"^({_LOT})$", 1)).otherwise(""),
    }
    known = rows.withColumn("named", on_page).where(own.contains("标段"))
    return reduce(DataFrame.unionByName, [_of(known.select("doc_id", F.lit(field.name).alias("field"), "pos", tidy(v).alias("value"), F.col("text").alias("evidence")).where("value != ''"), [field], m) for m, v in paths.items()])


def platforms(rows: DataFrame, field: Field, wanted: tuple[str, ...], never: tuple[str, ...]) -> DataFrame:
    """Names that end in 平台, one of each in a document; a short name that stands in brackets after a full one is an alias and goes, wherever it comes."""
    own = tx.squeezed(F.col("text"))
    name = "[一-鿿A-Za-z0-9·_]"
    short = rows.select("doc_id", F.explode(F.regexp_extract_all(own, F.lit(rf"{name}{{3,60}}平台[（(]({name}{{2,30}}平台)[）)]"), F.lit(1))).alias("value")).distinct()
    each = rows.select("doc_id", "pos", F.col("text").alias("evidence"), F.explode(F.regexp_extract_all(own, F.lit(rf"((?:{name}|[、-]){{2,80}}平台)"), F.lit(1))).alias("value"))
    each = each.where(tx.contains_any(F.col("value"), wanted) & ~tx.contains_any(F.col("value"), never) & ~F.col("value").rlike("^[0-9一二三四五六七八九十过请须应将在到由和]|[0-9]") & ~F.col("value").isin("电子平台", "交易平台", "电子交易平台"))
    each = each.join(short, ["doc_id", "value"], "left_anti")
    first = each.groupBy("doc_id", "value").agg(F.min(F.struct("pos", "evidence")).alias("at")).select("doc_id", F.lit(field.name).alias("field"), "at.pos", "value", "at.evidence")
    return _of(first, [field], "platform")


def suppressed(candidates: DataFrame, field: str, weak: str, strong: tuple[str, ...]) -> DataFrame:
    """Without a field's ``weak`` candidates in documents where a ``strong`` method has one."""
    has = F.bool_or((F.col("field") == field) & F.col("method").isin(*strong)).over(Window.partitionBy("doc_id", "field"))
    return candidates.withColumn("_has", has).where(~((F.col("field") == field) & (F.col("method") == weak) & F.col("_has"))).drop("_has")


def rerouted(candidates: DataFrame, source: str, target: str, words: tuple[str, ...]) -> DataFrame:
    """Candidates of ``source`` that hold one of ``words`` and no amount go to ``target``, unless it has the same value at the same place."""
    told = tx.contains_any(F.concat_ws(" ", "evidence", "value"), words) & ~values.is_valid("money", F.col("value"))
    moved = candidates.withColumn("_moved", (F.col("field") == source) & told).withColumn("field", F.when(F.col("_moved"), F.lit(target)).otherwise(F.col("field")))
    same = Window.partitionBy("doc_id", "field", "pos", "value").orderBy("_moved", "method")
    return moved.withColumn("_k", F.row_number().over(same)).where("_k = 1 or not _moved").drop("_moved", "_k")


def normalized(candidates: DataFrame, fields: list[Field]) -> DataFrame:
    """Candidates with their comparison value under their field's kind; null where the text is no value of it."""
    return candidates.withColumn("normalized", F.coalesce(*(F.when(F.col("field") == f.name, values.typed(f.kind, F.col("value"))) for f in fields)))


def facts(rows: DataFrame, keys: DataFrame, fields: list[Field]) -> DataFrame:
    """A row for each key and field: RESOLVED with its value, NEEDS_REVIEW or NOT_FOUND, from the paths that read lines.

    ``keys`` has the documents (key). Candidates of documents that ``keys`` doesn't have, and rows without doc_id, give nothing.
    """
    every = [same_line(rows, fields), next_line(rows, fields), keyword(rows, fields)]
    if any(f.multiline for f in fields):
        every.insert(2, multiline(rows, fields))
    both = resolution.union_first(every, ["doc_id", "field", "method", "pos", "value"], ["pos"])
    return resolution.dense(resolution.resolve_fields(normalized(both, fields), fields).withColumnRenamed("doc_id", "key"), keys, [f.name for f in fields])
