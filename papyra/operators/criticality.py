"""What a document says is substantive or rejecting: schedules that decide clauses, marked clauses, references, consequences, risk.

Tables are joined on the document and a clause number. Words come from the caller.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as tx

LABEL = r"(?U)^\s*[*★]?\s*([0-9]+(?:\.[0-9]+)+)\s*$"
MAX_DECISION = 240


def schedule_rows(cells: DataFrame, least: int = 2) -> DataFrame:
    """Rows of tables whose first column has at least ``least`` clause numbers: id, clause, marker, item (second cell), value (the rest, joined).

    ``cells`` has doc_id, table, row, col, page, text. Rows without a value are no decision. Ids run through the document.
    """
    named = F.regexp_extract(F.coalesce("text", F.lit("")), LABEL, 1)
    first = cells.where("col = 0").withColumn("clause", named)
    wide = first.groupBy("doc_id", "table").agg(F.count_if(F.col("clause") != "").alias("n")).where(F.col("n") >= least)
    label = first.where("clause != ''").join(wide, ["doc_id", "table"], "left_semi").select("doc_id", "table", "row", "page", "clause", F.ltrim("text").startswith("*").alias("marked"))
    rest = cells.where("col > 0").groupBy("doc_id", "table", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.trim(F.coalesce("text", F.lit(""))).alias("text")))).alias("c"))
    item = F.coalesce(F.max(F.when(F.col("col") == 1, F.trim("text"))), F.lit(""))
    items = cells.where("col > 0").groupBy("doc_id", "table", "row").agg(item.alias("item"))
    value = F.array_join(F.transform(F.filter("c", lambda x: (x["col"] > 1) & (x["text"] != "")), lambda x: x["text"]), "；")
    both = label.join(rest, ["doc_id", "table", "row"]).join(items, ["doc_id", "table", "row"]).withColumn("value", value).where("value != ''")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("table", "row"))
    return both.select("doc_id", F.format_string("SCH%04d", n).alias("id"), "table", "row", "page", "clause", F.when(F.col("marked"), "*").otherwise("").alias("marker"), "item", "value")


def is_pointer(value: Column) -> Column:
    """A value that only points elsewhere."""
    return F.trim(value).rlike("^(?:见|详见|按照?|参见)")


def parent_of(clause: Column) -> Column:
    """The clause number without its last part; null at the top."""
    return F.when(clause.contains("."), F.regexp_replace(clause, r"\.[^.]*$", ""))


def relation(text: Column, schedule: str, conditional: tuple[str, ...], duties: tuple[str, ...]) -> Column:
    """How a clause stands to the schedule it names (a pattern): it only refers, is overridden under a condition, or is completed. Null without one."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, schedule, ""), r"(?U)[\s。；;，,、：:（）()的]+", ""), r"^\**[0-9]+(?:\.[0-9]+)*", "")
    bare = F.regexp_replace(bare, "^(?:是否|能否)", "")
    return F.when(~text.rlike(schedule), F.lit(None)).when(F.char_length(bare) <= 12, "RESOLVES_REFERENCE").when(tx.contains_any(text, conditional), "OVERRIDES").when(tx.contains_any(text, duties), "SPECIALIZES")


def decided(clauses: DataFrame, schedule: DataFrame) -> DataFrame:
    """Clauses (doc_id, atom, clause, relation) with the schedule row that decides them: of their number, else of the parent's.

    Of several rows the first by: no pointer, usable, shorter value, page, row. A row is usable if its value is no pointer and has at
    most 240 characters; a clause whose best row isn't usable has none. Superseded: the clause isn't shown besides the row's value.
    """
    usable = ~is_pointer(F.col("value")) & (F.char_length("value") <= MAX_DECISION)
    rank = F.struct(is_pointer(F.col("value")).alias("p"), (~usable).alias("u"), F.char_length("value").alias("n"), F.coalesce("page", F.lit(0)).alias("page"), F.col("row").alias("row"), F.col("id").alias("id"))
    best = schedule.groupBy("doc_id", "clause").agg(F.min_by(F.struct("id", "item", "value", usable.alias("usable")), rank).alias("s"))
    own = clauses.where("relation is not null and clause != ''").join(best.withColumnRenamed("s", "own"), ["doc_id", "clause"], "left")
    up = best.select("doc_id", F.col("clause").alias("_parent"), F.col("s").alias("up"))
    both = own.withColumn("_parent", parent_of(F.col("clause"))).join(up, ["doc_id", "_parent"], "left")
    row = F.coalesce("own", "up")
    via = F.when(F.col("own").isNotNull(), "own").otherwise("parent")
    return both.withColumn("s", row).where("s.usable").select("doc_id", "atom", "clause", "relation", via.alias("via"), F.col("s.id").alias("row_id"), F.col("s.value").alias("value"), (F.col("relation") != "SPECIALIZES").alias("superseded"))


def applied(atoms: DataFrame, decisions: DataFrame) -> DataFrame:
    """Atoms after the decisions: superseded ones are flagged, and each deciding row comes as an atom of its own, once."""
    gone = decisions.where("superseded").select("doc_id", "atom", F.lit(True).alias("_gone")).distinct()
    own = atoms.join(gone, ["doc_id", "atom"], "left").select("doc_id", "atom", "text", F.coalesce("_gone", F.lit(False)).alias("superseded"), F.lit("source").alias("origin"))
    new = decisions.groupBy("doc_id", "row_id").agg(F.min("value").alias("text")).select("doc_id", F.concat(F.lit("SCH-"), "row_id").alias("atom"), "text", F.lit(False).alias("superseded"), F.lit("schedule").alias("origin"))
    return own.unionByName(new)


def carried_clauses(cells: DataFrame) -> DataFrame:
    """Each row of a table with its clause number, else that of the last row before it in the table that has one; empty before the first."""
    own = cells.where("col = 0").withColumn("own", F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), LABEL, 1), F.lit("")))
    order = Window.partitionBy("doc_id", "table").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("doc_id", "table", "row", F.coalesce(F.last("own", ignorenulls=True).over(order), F.lit("")).alias("clause"))


def headings_with_expiry(rows: DataFrame, heading: Column, pages: int = 1) -> DataFrame:
    """Each row with the last heading at or before it in its document, unless that stands more than ``pages`` pages before; empty then."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(heading, F.struct("text", "page")), ignorenulls=True).over(order)
    return rows.withColumn("_h", last).withColumn("heading", F.when(F.col("page") - F.col("_h.page") <= pages, F.col("_h.text")).otherwise("")).drop("_h")


def inherited(rows: DataFrame, head: Column, item: Column) -> DataFrame:
    """List items with the place of the head that they follow without a break (gaps and islands); others null, heads their own place."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    breaks = (head | ~item).cast("int")
    runs = rows.withColumns({"_run": F.sum(breaks).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_head": head})
    return runs.withColumn("head", F.max(F.when(F.col("_head"), F.col("pos"))).over(Window.partitionBy("doc_id", "_run"))).drop("_run", "_head")


class Scopes(NamedTuple):
    """Patterns of consequences, each for the stage that it belongs to; ``cue`` is any word of rejection."""

    cue: str
    rejection: str
    award: str
    late: str
    refused: str
    scoring: str
    liability: str


def consequence(text: Column, p: Scopes) -> Column:
    """The stage of a clause's consequence: of several the first of rejection, award, late submission (if refused), scoring, liability; else a procedure. Empty without any."""
    has = lambda x: text.rlike(x)
    some = reduce(lambda a, b: a | b, map(has, (p.cue, p.late, p.award, p.scoring, p.liability)))
    return (
        F.when(text.isNull() | ~some, "").when(has(p.rejection), "RESPONSE_REJECTION").when(has(p.award), "POST_AWARD").when(has(p.late) & has(p.refused), "LATE_SUBMISSION")
        .when(has(p.scoring), "SCORING_ONLY").when(has(p.liability), "CONTRACT_LIABILITY").otherwise("INFORMATIONAL")
    )


def references(text: Column) -> Column:
    """Clause numbers that a text cites after 第, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"第\s*([0-9]+(?:\.[0-9]+)+)\s*(?:条|项|款|目)?"), F.lit(1)))


def rejection_targets(rules: DataFrame, atoms: DataFrame) -> DataFrame:
    """Atoms (doc_id, atom, clause) that a rejecting rule (doc_id, rule, text, scope) names by clause number: each with its first rule."""
    named = rules.where("scope = 'RESPONSE_REJECTION'").select("doc_id", "rule", F.explode(references(F.col("text"))).alias("clause"))
    return atoms.join(named, ["doc_id", "clause"]).groupBy("doc_id", "atom").agg(F.min("rule").alias("rule"))


def section_references(atoms: DataFrame, headings: DataFrame) -> DataFrame:
    """Atoms (doc_id, atom, cites: a section's number) with the places of the section, from its heading to before the next of its level or above.

    ``headings`` has doc_id, pos, number, level. The end is null in a document's last section.
    """
    following = headings.alias("h").join(headings.alias("n"), (F.col("h.doc_id") == F.col("n.doc_id")) & (F.col("n.pos") > F.col("h.pos")) & (F.col("n.level") <= F.col("h.level")), "left")
    spans = following.groupBy(F.col("h.doc_id").alias("doc_id"), F.col("h.number").alias("number"), F.col("h.pos").alias("start")).agg(F.min("n.pos").alias("stop"))
    return atoms.join(spans.withColumnRenamed("number", "cites"), ["doc_id", "cites"]).select("doc_id", "atom", "cites", "start", "stop")


def marked_atoms(atoms: DataFrame, marks: DataFrame, least: int = 8) -> DataFrame:
    """Atoms (doc_id, atom, clause, page, key) that a marked occurrence (doc_id, mark, clause, page, key) belongs to, each with every route.

    Routes: the same clause number; the same text; the occurrence's text within the atom's or the other way round on one page,
    the shorter of at least ``least`` characters. Keys are texts without white space.
    """
    a, m = atoms.alias("a"), marks.alias("m")
    doc = F.col("a.doc_id") == F.col("m.doc_id")
    route = lambda on, name: a.join(m, doc & on).select(F.col("a.doc_id").alias("doc_id"), F.col("a.atom").alias("atom"), F.col("m.mark").alias("mark"), F.lit(name).alias("route"))
    col = F.col
    clause = route((col("a.clause") == col("m.clause")) & (col("a.clause") != ""), "clause")
    same = route(col("a.key") == col("m.key"), "text")
    page = (col("a.page") == col("m.page")) & (col("a.key") != col("m.key"))
    held = route(page & (F.char_length("m.key") >= least) & F.contains(col("a.key"), col("m.key")), "holds")
    part = route(page & (F.char_length("a.key") >= least) & F.contains(col("m.key"), col("a.key")), "within")
    return clause.unionByName(same).unionByName(held).unionByName(part).distinct()


def adopted(marks: DataFrame, routes: DataFrame, least: int = 12) -> DataFrame:
    """Marks without an atom that take over the atoms of a mark whose text begins with theirs, or theirs with its; at least ``least`` characters agree.

    Marks meet in a join on the first ``least`` characters of their keys.
    """
    own = marks.select("doc_id", "mark", "key", F.left("key", F.lit(least)).alias("head")).where(F.char_length("key") >= least)
    donor = own.join(routes.select("doc_id", "mark", "atom").distinct(), ["doc_id", "mark"]).select("doc_id", "head", F.col("key").alias("other"), F.col("mark").alias("donor"), "atom")
    left = own.join(routes, ["doc_id", "mark"], "left_anti")
    met = left.join(donor, ["doc_id", "head"]).where(F.startswith("key", "other") | F.startswith("other", "key"))
    return met.groupBy("doc_id", "mark", "atom").agg(F.min("donor").alias("donor"))


# Bases in order of precedence, levels and risks from the strongest down.
BASES = ("SOURCE_MARKER", "EXPLICIT_WORDING", "LEGAL_RULE", "REFERENCE")
LEVELS = ("SUBSTANTIVE_REJECTION", "SUBSTANTIVE", "MANDATORY", "ORDINARY")
RISKS = ("veto", "high", "medium", "low")


def criticality(atoms: DataFrame) -> DataFrame:
    """Level and basis of atoms from flags: marker (and what the source says it ``means``), wording, legal, referred, rejected, proof.

    A marker counts as a basis only where the document says that it marks what is substantive. An atom that a rejecting rule names is
    SUBSTANTIVE_REJECTION, whatever its basis; a marker that asks for proof or points gives MANDATORY. A star alone rejects nothing.
    """
    c = F.col
    star = c("marker") & (c("means") == "SUBSTANTIVE")
    basis = F.when(star, BASES[0]).when(c("wording"), BASES[1]).when(c("legal"), BASES[2]).when(c("referred"), BASES[3])
    asked = c("marker") & c("means").isin("PROOF", "SCORING")
    level = F.when(c("rejected"), LEVELS[0]).when(basis.isNotNull(), LEVELS[1]).when(asked, LEVELS[2]).otherwise(LEVELS[3])
    return atoms.withColumns({"basis": basis, "level": level})


def strongest_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per key the strongest level, whether any row rejects, and how many rows there are."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return rows.groupBy(*key).agg(F.element_at(F.array(*map(F.lit, LEVELS)), F.min(rank).cast("int")).alias("level"), F.coalesce(F.bool_or("rejected"), F.lit(False)).alias("rejects"), F.count("*").alias("atoms"))


def stage(concern: Column, kind: Column, text: Column, asks: str, consequence_here: Column) -> Column:
    """A concern's stage by its kind and what its source asks (a pattern) of the response; the chapter it stands in says nothing."""
    return (
        F.when(concern.startswith("SCORING_") | (kind == "SCORING"), "SCORING_RESPONSE")
        .when((kind == "CONTRACT_ONLY") & ~(text.rlike(asks) | consequence_here), "CONTRACT_RISK_NOTICE").when(kind == "INFORMATIONAL", "INFORMATIONAL").otherwise("BID_RESPONSE")
    )


def risk(default: Column, level: Column, rejects: Column, stage: Column) -> Column:
    """A row's risk: a notice's, an informational row's low, a rejection's veto, else the stronger of type and level, but never a veto that the source doesn't state."""
    own = F.when(level == "SUBSTANTIVE_REJECTION", "veto").when(level == "SUBSTANTIVE", "high").otherwise("medium")
    rank = lambda c: F.array_position(F.array(*map(F.lit, RISKS)), c)
    capped = F.when(own == "medium", "high").otherwise(own)
    stronger = F.when(rank(default) <= rank(own), default).otherwise(own)
    return F.when(stage == "CONTRACT_RISK_NOTICE", "notice").when(stage == "INFORMATIONAL", "low").when(level.isNull(), default).when(rejects, "veto").when(default == "veto", capped).otherwise(stronger)


def review_order(items: DataFrame, modules: list[str]) -> DataFrame:
    """Items (doc_id, id, module, default: their type's risk, decision) with their place: module, risk of the type (decisions last), id."""
    rank = lambda c, xs: F.when(c.isin(*xs), F.array_position(F.array(*map(F.lit, xs)), c)).otherwise(len(xs) + 1)
    own = F.when(F.col("decision"), len(RISKS)).otherwise(rank(F.col("default"), list(RISKS)))
    return items.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank(F.col("module"), modules), own, "id")))


def stable_order(known: DataFrame, found: DataFrame) -> DataFrame:
    """Concerns of ``found`` (doc_id, concern, first) in the order of ``known`` (doc_id, concern, ordinal), new ones after them by first place."""
    both = found.join(known, ["doc_id", "concern"], "left")
    return both.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("ordinal").isNull(), "ordinal", "first", "concern"))).select("doc_id", "concern", "place")
