"""Requirements to atoms to concerns: sentences, classes by ordered rules, groups with their numbers, checks of what is shown."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as tx


class ConcernRule(NamedTuple):
    concern: str
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()


def sentences(text: Column, most: int = 120) -> Column:
    """A text's sentences, cut after 。；;！? and line ends; one of more than ``most`` characters in pieces of whole comma parts that fit, or one part alone."""
    whole = F.filter(F.transform(F.split(F.regexp_replace(text, "([。；;！!？?\n])", "$1\u001e"), "\u001e"), lambda x: F.trim(x)), lambda x: x != "")

    def pieces(s: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(s, "([，,、])", "$1\u001e"), "\u001e"), lambda x: x != "")
        fits = lambda acc, x: (F.size(acc) > 0) & (F.char_length(F.element_at(acc, -1)) + F.char_length(x) <= most)
        glued = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), x)))
        return F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(fits(acc, x), glued(acc, x)).otherwise(F.concat(acc, F.array(x))))

    return F.flatten(F.transform(whole, lambda s: F.when(F.char_length(s) > most, pieces(s)).otherwise(F.array(s))))


def atoms(units: DataFrame, most: int = 120) -> DataFrame:
    """Units (doc_id, id, text) as atoms: SRA with the unit's number, and .1, .2, ... where it has several."""
    each = units.withColumn("_s", sentences(F.col("text"), most)).withColumn("_n", F.size("_s"))
    rows = each.select("doc_id", "id", "_n", F.posexplode("_s").alias("k", "text"))
    base = F.concat(F.lit("SRA"), F.regexp_extract("id", "([0-9]+)$", 1))
    return rows.select("doc_id", "id", F.when(F.col("_n") > 1, F.concat_ws(".", base, (F.col("k") + 1).cast("string"))).otherwise(base).alias("atom"), "k", "text")


def classified(rows: DataFrame, rules: list[ConcernRule], rest: str = "UNCLASSIFIED") -> DataFrame:
    """Rows with the concern of the first rule that fits: one of any_of (if there are any), all of all_of, none of none_of."""
    text, out = F.col("text"), F.lit(rest)
    for r in reversed(rules):
        ok = tx.contains_any(text, r.any_of) if r.any_of else F.lit(True)
        ok = reduce(lambda a, w: a & text.contains(w), r.all_of, ok) & ~tx.contains_any(text, r.none_of)
        out = F.when(ok, F.lit(r.concern)).otherwise(out)
    return rows.withColumn("concern", out)


def grouped(rows: DataFrame) -> DataFrame:
    """Concerns of each document: their atoms in order, the first place, whether any is mandatory or of high risk.

    ``rows`` has doc_id, concern, atom, n (place), mandatory, high_risk.
    """
    ids = F.transform(F.array_sort(F.collect_list(F.struct("n", "atom"))), lambda x: x["atom"])
    return rows.groupBy("doc_id", "concern").agg(ids.alias("atoms"), F.min("n").alias("first"), F.bool_or("mandatory").alias("mandatory"), F.bool_or("high_risk").alias("high_risk"))


def actionable(groups: DataFrame, informational: tuple[str, ...]) -> DataFrame:
    """Concerns with whether they ask for action: all but informational ones, and of these what is mandatory or of high risk, which is never lost."""
    return groups.withColumn("actionable", ~F.col("concern").isin(*informational) | F.col("mandatory") | F.col("high_risk"))


def adopting(rows: DataFrame, anaphora: tuple[str, ...], weak: str = "UNCLASSIFIED") -> DataFrame:
    """Unclassified rows that begin with a word of reference take the concern of their clause, if its other rows have exactly one."""
    others = F.array_compact(F.collect_set(F.when(F.col("concern") != weak, F.col("concern"))).over(Window.partitionBy("doc_id", "clause")))
    begins = reduce(lambda a, w: a | F.startswith(F.trim("text"), F.lit(w)), anaphora, F.lit(False))
    take = (F.col("concern") == weak) & begins & (F.size(others) == 1) & (F.col("clause") != "")
    return rows.withColumn("_o", others).withColumn("concern", F.when(take, F.get("_o", F.lit(0))).otherwise(F.col("concern"))).drop("_o")


class Role(NamedTuple):
    """A number's role: units that it needs (a pattern of the number with its unit) and words near it."""

    name: str
    unit: str
    near: tuple[str, ...] = ()


NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:万元|元|%|％|个月|月|年|小时|分钟|日历天|自然日|工作日|天|日|周|分|台|套|份|项|次|名|人|个)?"


def numbers(rows: DataFrame, roles: list[Role], window: int = 30) -> DataFrame:
    """Numbers of each text with their unit, role and context; each (number, role) of an id once, at its first place.

    A number after 第, with two or more dots or before 页, 条, 款, 章 or 节 is a reference and left out. The role is the first whose
    unit fits and one of whose words stands within ``window`` characters; OTHER without one.
    """
    marked = F.regexp_replace("text", f"({NUMBER})", "\u001e$1\u001e")
    parts = F.split(marked, "\u001e")  # text, number, text, number, ...
    each = rows.select("doc_id", "id", F.posexplode(parts).alias("i", "raw"), parts.alias("p")).where("i % 2 = 1")
    before = F.array_join(F.slice("p", F.lit(1), F.col("i")), "")
    after = F.array_join(F.slice("p", F.col("i") + 2, F.size("p")), "")
    value = tx.squeezed(F.col("raw"))
    around = F.concat(F.right(before, F.lit(window)), "raw", F.left(after, F.lit(window)))
    cited = before.rlike(r"(?U)第\s*$|[0-9]\.$") | after.rlike(r"^(?:\.[0-9]|[页条款章节])") | value.rlike(r"^[0-9]+(?:\.[0-9]+){2,}")
    role = F.lit("OTHER")
    for r in reversed(roles):
        role = F.when(F.col("value").rlike(f"(?:{r.unit})$") & (tx.contains_any(F.col("around"), r.near) if r.near else F.lit(True)), F.lit(r.name)).otherwise(role)
    found = each.where(~cited).withColumns({"value": value, "around": around}).withColumn("role", role)
    return found.groupBy("doc_id", "id", "value", "role").agg(F.min("i").alias("at"))


def tiers(text: Column) -> Column:
    """(condition, score) of each numbered alternative of a scoring standard; none where fewer than two are numbered, null of a null text."""
    marks = r"(?:^|(?<=[；;。：:\s）)]))[(（]?[0-9]{1,2}[)）、.．](?![0-9])"
    parts = F.split(F.regexp_replace(text, marks, "\u001e"), "\u001e")
    own = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    score = r"(?:的)?(?:得|计|为)\s*([0-9]+(?:\.[0-9]+)?)\s*分"
    pair = lambda s: F.struct(F.trim(F.btrim(F.regexp_extract(s, rf"^(.*?){score}", 1), F.lit(" 　，,；;：:。的"))).alias("condition"), F.concat(F.regexp_extract(s, score, 1), F.lit("分")).alias("score"))
    found = F.filter(F.transform(own, pair), lambda x: (x["condition"] != "") & (x["score"] != "分"))
    return F.when(text.isNull() | (F.size(own) >= 2), found).otherwise(F.array().cast("array<struct<condition:string,score:string>>"))


def unowned(shown: Column, owned: Column) -> Column:
    """Parts that are shown but that their source doesn't own."""
    return F.array_except(shown, owned)


def fill_slots(text: Column) -> Column:
    """(kind, label) of places to fill in: runs of underscores with the text before them, and bracketed hints."""
    lines = F.regexp_extract_all(text, F.lit(r"([^_＿\s：:（(）)]{0,20})\s*[：:]?\s*[_＿]{2,}"), F.lit(1))
    hints = F.regexp_extract_all(text, F.lit(r"[（(]([^（()）]{1,24})[）)]"), F.lit(1))
    kind = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("label"))
    return F.concat(F.transform(lines, kind("line")), F.transform(hints, kind("hint")))


def price_rows(cells: DataFrame, heads: tuple[str, ...], least: int = 2) -> DataFrame:
    """Rows of price tables with the head that they stand under: the last row before them, on the same or the previous page, with ``least`` of the words ``heads``.

    ``cells`` has doc_id, page, table, row, col, text. Heads themselves and rows whose first cell isn't a number are left out.
    """
    text = F.coalesce(F.trim("text"), F.lit(""))
    rows = cells.groupBy("doc_id", "page", "table", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", text.alias("t")))), lambda x: x["t"]).alias("c"))
    order = Window.partitionBy("doc_id").orderBy("page", "table", "row").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.size(F.filter("c", lambda x: tx.contains_any(x, heads))) >= least
    own = rows.withColumn("_is", is_head).withColumn("_h", F.last(F.when(F.col("_is"), F.struct("page", "c")), ignorenulls=True).over(order))
    kept = own.where(~F.col("_is") & F.col("_h").isNotNull() & (F.col("page") - F.col("_h.page") <= 1) & (F.size("c") == F.size("_h.c")) & F.col("c")[0].rlike("^[0-9]+$"))
    return kept.select("doc_id", "page", "table", "row", F.map_from_arrays(F.transform("_h.c", lambda x, i: F.concat(i.cast("string"), F.lit(" "), x)), "c").alias("cells"))


def completed(rows: DataFrame, most: int = 2) -> DataFrame:
    """Fragments that stop within a sentence with the following ones of their page added, at most ``most``, until one ends it."""
    order = Window.partitionBy("doc_id", "page").orderBy("pos")
    ends = r"[。；;！!？?]$"
    out, open_ = F.col("text"), ~F.rtrim("text").rlike(ends)
    for i in range(1, most + 1):
        nxt = F.lead("text", i).over(order)
        out = F.when(open_ & nxt.isNotNull(), F.concat(out, nxt)).otherwise(out)
        open_ = open_ & nxt.isNotNull() & ~F.rtrim(nxt).rlike(ends)
    return rows.withColumn("whole", out)


def evidence_units(atoms_: DataFrame, units: DataFrame) -> DataFrame:
    """Each atom (doc_id, atom, page, key) with the unit (doc_id, unit, page, pos, key) that holds it or that it holds: nearer pages first, then more in common, then the first.

    Units of the atom's page and the pages beside it are looked at; keys are texts without white space, empty ones hold nothing.
    """
    near = F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("at")
    a = atoms_.where("key != ''").select("doc_id", "atom", "page", "key", near)
    u = units.where("key != ''").select("doc_id", "unit", F.col("page").alias("at"), "pos", F.col("key").alias("other"))
    met = a.join(u, ["doc_id", "at"]).where(F.contains("other", "key") | F.contains("key", "other"))
    score = F.least(F.char_length("key"), F.char_length("other"))
    return met.groupBy("doc_id", "atom").agg(F.min_by("unit", F.struct(F.abs(F.col("at") - F.col("page")).alias("p"), (-score).alias("s"), "pos")).alias("unit"))


def used_by(index: DataFrame, rows: DataFrame, least: int = 20) -> DataFrame:
    """Evidence (doc_id, evidence, page, excerpt) with the rows (doc_id, id, page, excerpt) of its page whose excerpt holds its first ``least`` characters."""
    e, r = index.alias("e"), rows.alias("r")
    met = e.join(r, (F.col("e.doc_id") == F.col("r.doc_id")) & (F.col("e.page") == F.col("r.page")) & F.contains(F.col("r.excerpt"), F.left(F.col("e.excerpt"), F.lit(least))), "left")
    return met.groupBy(F.col("e.doc_id").alias("doc_id"), F.col("e.evidence").alias("evidence")).agg(F.array_sort(F.array_compact(F.collect_set("r.id"))).alias("used"))


def units_of(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Evidence units in order: blocks, and table rows with their cells joined by bars, each with the heading and clause number that hold for it.

    ``blocks`` has doc_id, page, pos, text; ``cells`` doc_id, page, pos, table, row, col, text. A heading holds until the next one and
    one page on; a row without a clause number has that of the last row before it in its table.
    """
    from papyra.operators import criticality as cr
    from papyra.operators import requirements as rq

    parts = F.transform(F.array_sort(F.collect_list(F.struct("col", F.trim("text").alias("t")))), lambda x: x["t"])
    rows = cells.groupBy("doc_id", "page", "table", "row").agg(F.min("pos").alias("pos"), F.array_join(F.filter(parts, lambda x: x != ""), " | ").alias("text"))
    rows = rows.where("text != ''").join(cr.carried_clauses(cells), ["doc_id", "table", "row"], "left").select("doc_id", "page", "pos", "text", F.lit("row").alias("kind"), F.coalesce("clause", F.lit("")).alias("clause"))
    own = blocks.where("trim(text) != ''").select("doc_id", "page", "pos", "text", F.lit("block").alias("kind"), rq.clause_number(F.col("text")).alias("clause"))
    every = own.unionByName(rows)
    placed = cr.headings_with_expiry(every, (F.col("kind") == "block") & tx.is_structural_heading(F.col("text")))
    return placed.withColumn("unit", F.format_string("EU%04d", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))))


def facets(atoms_: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Further atoms for facets (suffix, concern, pattern) that an atom's text has, where no atom of the document has that concern already.

    ``atoms_`` has doc_id, atom, concern, text. The test is on the atoms as they come, so that one facet doesn't keep another out.
    """
    owned = atoms_.select("doc_id", "concern").distinct()
    out = [atoms_.where(F.col("text").rlike(p)).select("doc_id", F.concat_ws(".", "atom", F.lit(s)).alias("atom"), F.lit(c).alias("concern"), "text").join(owned, ["doc_id", "concern"], "left_anti") for s, c, p in rules]
    return reduce(DataFrame.unionByName, out).select("doc_id", "atom", "concern", "text")


def owned_numbers(numbers_: DataFrame, members: DataFrame, roles: list[tuple[str, str]]) -> DataFrame:
    """Numbers (doc_id, id, value, role, at) of each concern's members (doc_id, concern, id) whose role (concern, role) it may own: each (value, role) once, in order."""
    may = F.lit(False)
    for c, r in roles:
        may = may | ((F.col("concern") == c) & (F.col("role") == r))
    met = members.join(numbers_, ["doc_id", "id"]).where(may).groupBy("doc_id", "concern", "value", "role").agg(F.min(F.struct("id", "at")).alias("first"))
    return met.groupBy("doc_id", "concern").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "value", "role"))), lambda x: F.concat_ws(":", x["role"], x["value"])).alias("numbers"))


def rendered(rows: DataFrame, templates: dict[str, str], default: str = "{text}") -> DataFrame:
    """Each row's text by its concern's template: {name} stands for the row's column of that name, empty if it is null."""
    out = F.lit(default)
    for concern, t in templates.items():
        out = F.when(F.col("concern") == concern, F.lit(t)).otherwise(out)
    for c in rows.columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.withColumn("rendered", out)


def primary_sources(members: DataFrame, words: dict[str, tuple[str, ...]]) -> DataFrame:
    """Of each concern's members (doc_id, concern, atom, n, text, mandatory) the one that stands for it: most of its words, mandatory, a figure, the first."""
    score = F.lit(0)
    for concern, ws in words.items():
        score = F.when(F.col("concern") == concern, sum((F.contains("text", F.lit(w)).cast("int") for w in ws), F.lit(0))).otherwise(score)
    rank = F.struct((-score).alias("s"), (~F.col("mandatory")).alias("m"), (~F.col("text").rlike("[0-9]")).alias("f"), "n")
    return members.groupBy("doc_id", "concern").agg(F.min_by(F.struct("atom", "text"), rank).alias("p"), F.count("*").alias("members")).select("doc_id", "concern", "p.atom", "p.text", "members")


def related(items: DataFrame, facts: DataFrame, decisions: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Items (doc_id, id, concern, atom) with the fact of their concern's field and the schedule's decision for their atom; nulls without."""
    field = F.lit(None).cast("string")
    for concern, f in fields.items():
        field = F.when(F.col("concern") == concern, F.lit(f)).otherwise(field)
    a = items.withColumn("field", field).join(facts.where("status = 'RESOLVED'").select("doc_id", "field", F.col("value").alias("fact")), ["doc_id", "field"], "left")
    return a.join(decisions.select("doc_id", "atom", F.col("value").alias("decision")), ["doc_id", "atom"], "left").select("doc_id", "id", "concern", "field", "fact", "decision")
