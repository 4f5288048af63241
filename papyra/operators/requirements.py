"""Requirement index: fragments joined, split into clauses, typed, given topics, kept or dropped with a reason, numbered, folded.

Words are a lexicon that callers pass in; ``Lexicon()`` knows none. Text is handled with built-in expressions: separators
are set by patterns, and what depends on the clause before is a fold over one fragment's clauses. Null texts give nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as tx


class Lexicon(NamedTuple):
    strong: tuple[str, ...] = ()
    mandatory: tuple[str, ...] = ()
    exclusion: tuple[str, ...] = ()
    criteria: tuple[str, ...] = ()
    verbs: tuple[str, ...] = ()
    navigation: tuple[str, ...] = ()
    governing: tuple[str, ...] = ()
    buyers: tuple[str, ...] = ()
    bidders: tuple[str, ...] = ()
    #: (type, topic, words) in order of precedence; REJECTION topics are only for what is rejecting.
    topics: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    #: (topic, words) for what has no type.
    others: tuple[tuple[str, tuple[str, ...]], ...] = ()
    modules: tuple[tuple[str, str], ...] = ()
    risks: tuple[tuple[str, str], ...] = ()


# Marks of emphasis; kinds of values with their units and the dates that are none; characters that end a sentence;
# forms of clause numbers, in order; titles, marked clauses and rows of front tables; lengths.
MARKS = "*★▲◆●"
VALUE_KINDS = (
    ("money", r"[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:万元|元)"),
    ("percent", r"[0-9]+(?:\.[0-9]+)?\s*%"),
    ("duration", r"[0-9]+\s*个?(?:日历天|自然日|天|个月|月|年|小时)(?!\s*[月日])"),
    ("count", r"[0-9]+\s*(?:份|台|套|人|名|册|倍)"),
    ("score", r"[0-9]+(?:\.[0-9]+)?\s*分(?!值)"),
)
SCORING = ("得分", "评分", "分值", "扣分", "加分", "技术分", "商务分", "价格分", "评审分", "总分")
ENDS = "。；;！!?"
DATES = (r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月(?:\s*[0-9]{1,2}\s*日)?", r"[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日", r"[0-9]{1,2}\s*[:：]\s*[0-9]{2}", r"[0-9]{1,2}\s*时\s*[0-9]{1,2}\s*分?")

CLAUSE_FORMS = (r"\b(A[0-9]+(?:\.[0-9]+)*)\b", r"第\s*([0-9]+(?:\.[0-9]+)*)\s*条", r"^([0-9]+(?:\.[0-9]+){1,4})", "^([一二三四五六七八九十百]{1,3}[、.．])", r"^([（(]\s*[0-9]{1,3}\s*[）)])")
CHAPTER = "第[一-龥0-9]{1,3}[章节篇部分条]"
TITLE = r"^(?:第[一二三四五六七八九十百千万零〇0-9]+[章节篇部分]|[一二三四五六七八九十百千万]{1,3}[、.．)]|[0-9]+(?:\.[0-9]+)*[、.．)])?[^。；;：:]{0,26}$"
MARKED = r"(?U)^\s*[*★]\s*(?:[0-9]+(?:\.[0-9]+)*|[一-鿿])"
FRONT_ROW = r"(?U)^\s*[*★]?\s*[0-9]+(?:\.[0-9]+)+\s+\S{1,12}\s+\S{1,12}\s*$"
JOINED_CHARS, GAP, TITLE_CHARS, LEAST_CHARS, TAIL_CHARS = 600, 25, 60, 6, 10

_CUT = "\u001e"


def ends_sentence(text: Column) -> Column:
    return F.rtrim(text).rlike(f"[{ENDS}]$")


def assembled(rows: DataFrame, cap: int = JOINED_CHARS, gap: int = GAP) -> DataFrame:
    """Fragments that are one sentence split by the layout, joined: doc_id, pos, page, kind, text, fragments; the last one's place counts.

    ``rows`` has doc_id, pos, page, kind (block or cell), text and, for cells, table. A fragment goes on in the next of
    its kind on the same page, or for blocks the next page, at most ``gap`` places on (cells: 1, 1000 or 1001 within
    a table), unless it ends a sentence or has reached ``cap`` characters. The first three are a running number of
    breaks; the cap hangs on what was joined so far, so it is a fold over the lengths of each such run.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    table = F.col("table") if "table" in rows.columns else F.lit(None).cast("int")
    was = lambda c: F.lag(c).over(order)
    own = rows.where("text is not null").withColumn("table", table)
    step = F.col("pos") - was("pos")
    near = F.when(F.col("kind") == "cell", F.col("table").eqNullSafe(was("table")) & step.isin(1, 1000, 1001)).otherwise(step <= gap)
    turn = (F.col("page") == was("page")) | ((F.col("kind") == "block") & (F.col("page") == was("page") + 1))
    # A text that ends in a mark which leaves a sentence open ends none, so the test for an end is enough.
    on = (F.col("kind") == was("kind")) & turn & near & ~ends_sentence(was("text"))
    runs = own.withColumn("begins", (~F.coalesce(on, F.lit(False))).cast("int")).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = runs.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "kind", "text"))).alias("p"))

    def fold(acc: Column, x: Column) -> Column:
        n = F.char_length(x["text"])
        new = (acc["n"] < 0) | (acc["n"] >= cap)
        return F.struct(F.when(new, n).otherwise(acc["n"] + 1 + n).alias("n"), F.concat(acc["g"], F.array(F.element_at(acc["g"], -1) + new.cast("int"))).alias("g"))

    groups = F.aggregate("p", F.struct(F.lit(-1).alias("n"), F.array(F.lit(0)).alias("g")), fold, lambda a: F.slice(a["g"], F.lit(2), F.size(a["g"]) - 1))
    each = parts.withColumn("g", groups).select("doc_id", "run", F.explode(F.arrays_zip("p", "g")).alias("x")).groupBy("doc_id", "run", "x.g").agg(F.array_sort(F.collect_list("x.p")).alias("p"))
    last = F.element_at("p", -1)
    return each.select("doc_id", last["pos"].alias("pos"), last["page"].alias("page"), last["kind"].alias("kind"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"), F.size("p").alias("fragments"))


def clauses(text: Column) -> Column:
    """One fragment's statements, in order: cut after 。；; and line ends, before inline clause numbers (not where 第 cites one) and before a chapter's title at a statement's end.

    A piece of fewer than ten characters belongs to the one before it; a mark of emphasis goes to the clause that follows it.
    """
    head = F.regexp_extract(text, rf"(?U)^\s*([{MARKS}])", 1)
    body = F.regexp_replace(text, rf"(?U)^\s*[{MARKS}]\s*", "")
    cut = F.regexp_replace(body, "([。；;\n])", f"$1{_CUT}")
    cut = F.regexp_replace(cut, rf"(?U)(?<!第)(?<!第\s)(?=A[0-9]{{1,2}}\.[0-9]{{1,2}})|(?<![0-9.第])(?<!第\s)(?=[0-9]{{1,2}}(?:\.[0-9]{{1,2}}){{1,3}}\s*[一-鿿（(])", _CUT)
    cut = F.regexp_replace(cut, rf"(?U)(?<=\S)\s+({CHAPTER}\s*)(?={_CUT}|$)", f"{_CUT}$1")
    pieces = F.filter(F.transform(F.split(cut, _CUT), lambda x: F.trim(x)), lambda x: tx.squeezed(x) != "")
    title = rf"^(?:{CHAPTER}|[一二三四五六七八九十]+[、.]\s*\S{{0,30}})$"

    def merge(acc: Column, x: Column) -> Column:
        short = (F.size(acc) > 0) & (F.char_length(tx.collapsed(x)) < TAIL_CHARS) & ~x.rlike(title)
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(acc, -1), x)))
        return F.when(short, joined).otherwise(F.concat(acc, F.array(x)))

    def marked(acc: Column, x: Column) -> Column:
        whole = F.trim(F.concat_ws(" ", F.nullif(acc["pending"], F.lit("")), x))
        mark = F.regexp_extract(whole, rf"(?U)([{MARKS}])\s*$", 1)
        rest = F.rtrim(F.regexp_replace(whole, rf"(?U)[{MARKS}]\s*$", ""))
        alone = whole.rlike(rf"^[{MARKS}]$")
        hangs = (mark != "") & (F.char_length(whole) > 2)
        out = F.when(alone, acc["out"]).when(hangs, F.concat(acc["out"], F.array(rest))).otherwise(F.concat(acc["out"], F.array(whole)))
        return F.struct(out.alias("out"), F.when(alone, whole).when(hangs, mark).otherwise("").alias("pending"))

    none = F.array().cast("array<string>")
    merged = F.aggregate(pieces, none, merge)
    done = F.aggregate(merged, F.struct(none.alias("out"), F.lit("").alias("pending")), marked, lambda a: F.when(a["pending"] != "", F.concat(a["out"], F.array(a["pending"]))).otherwise(a["out"]))
    first = F.concat(F.array(F.concat(head, F.coalesce(F.get(done, F.lit(0)), F.lit("")))), F.slice(done, F.lit(2), F.greatest(F.size(done) - 1, F.lit(0))))
    return F.when((head != "") & ~F.coalesce(F.get(done, F.lit(0)), F.lit("")).startswith(head), first).otherwise(done)


def extracted_values(text: Column, most: int = 12) -> Column:
    """Amounts, shares, spans, counts and (where a clause talks of scoring) scores, without white space, each once, by kind and place."""
    masked = text
    for d in DATES:
        masked = F.regexp_replace(masked, d, " ")

    def found(masked: Column) -> Column:
        out = []
        for kind, p in VALUE_KINDS:
            own = F.regexp_extract_all(masked, F.lit(rf"(?U)((?<![0-9.{'' if kind == 'percent' else '第'}]){p})"), F.lit(1))
            out.append(F.when(tx.contains_any(text, SCORING), own).otherwise(F.array().cast("array<string>")) if kind == "score" else own)
        return F.slice(F.array_distinct(F.transform(F.concat(*out), tx.squeezed)), 1, most)

    return tx.let(masked, found)


def clause_number(text: Column) -> Column:
    """A clause's own number, without a mark of emphasis before it; empty without one."""
    own = F.regexp_replace(text, rf"(?U)^\s*[{MARKS}]\s*", "")
    return F.trim(F.coalesce(*(F.nullif(F.regexp_extract(own, p, 1), F.lit("")) for p in CLAUSE_FORMS), F.lit("")))


def governs(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a clause opens a list whose items take on its force."""
    return F.rtrim(text).rlike("[：:]$") | tx.contains_any(text, words)


def binds_only(text: Column, buyers: tuple[str, ...], bidders: tuple[str, ...]) -> Column:
    return tx.contains_any(text, buyers) & ~tx.contains_any(text, bidders)


def type_of(text: Column, strong: Column, lex: Lexicon) -> Column:
    """REJECTION for strong or excluding words, else the type of the first topic rule one of whose words the text holds, else OTHER."""
    low = F.lower(text)
    out = F.lit("OTHER")
    for kind, _, words in reversed([t for t in lex.topics if t[0] != "REJECTION"]):
        out = F.when(tx.contains_any(low, tuple(w.lower() for w in words)), F.lit(kind)).otherwise(out)
    return F.when(strong | tx.contains_any(text, lex.exclusion), F.lit("REJECTION")).otherwise(out)


def topic_of(kind: Column, text: Column, lex: Lexicon, general: str = "general", rejecting: str = "other rejection", other: str = "other") -> Column:
    """The first topic of the text's own type, else a fallback of the type."""
    low = F.lower(text)
    rest = F.lit(other)
    for name, words in reversed(lex.others):
        rest = F.when(tx.contains_any(text, words), F.lit(name)).otherwise(rest)
    out = F.when(kind == "REJECTION", F.lit(rejecting)).when(kind == "OTHER", rest).otherwise(F.lit(general))
    for k, name, words in reversed(lex.topics):
        out = F.when((kind == k) & tx.contains_any(low, tuple(w.lower() for w in words)), F.lit(name)).otherwise(out)
    return out


def _mapped(pairs: tuple[tuple[str, str], ...], key: Column, default: str) -> Column:
    if not pairs:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in pairs for x in p)), key), F.lit(default))


def judged(fragments: DataFrame, lex: Lexicon) -> DataFrame:
    """Every clause of ``fragments`` (doc_id, pos, text) with its place, words, values and reason: kept, rescued or why it was dropped.

    An item that says nothing by itself stands after the clause that governs it, the last one before it in its fragment that
    opens a list; a strong clause that ends its sentence ends that. Reasons: navigation, heading (also what neither has strong or
    mandatory words nor values nor a topic with a verb), short (under six characters), procedural (binds the buyer only).
    Rescued: marked clauses that would be dropped as saying nothing.
    """
    own = fragments.where("text is not null").withColumn("block", tx.collapsed(F.col("text")))
    whole = tx.contains_any(F.col("block"), lex.navigation)
    each = own.select("doc_id", "pos", whole.alias("nav"), F.posexplode_outer(F.when(~whole & (F.col("block") != ""), clauses(F.col("text")))).alias("k", "raw"))
    each = each.withColumns({"k": F.coalesce("k", F.lit(0)), "said": tx.collapsed(F.coalesce("raw", F.lit("")))})
    own_words = lambda c: (F.size(tx.hits(F.lower(c), tuple(w.lower() for w in lex.strong))) > 0, tx.contains_any(c, lex.mandatory), F.size(extracted_values(c)) > 0)
    s, m, v = own_words(F.col("said"))
    opens = governs(F.col("said"), lex.governing)
    closes = s & ends_sentence(F.col("said")) & ~opens
    before = Window.partitionBy("doc_id", "pos").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(opens, F.left("said", F.lit(160))).when(closes, F.lit("")), ignorenulls=True).over(before)
    each = each.withColumn("governing", F.coalesce(state, F.lit(""))).withColumn("text", F.when((F.col("governing") != "") & ~s & ~m & ~v, F.concat_ws(" ", "governing", "said")).otherwise(F.col("said")))
    text = F.col("text")
    each = each.withColumns({"strong": tx.hits(F.lower(text), tuple(w.lower() for w in lex.strong)), "mandatory": tx.hits(text, lex.mandatory), "values": extracted_values(text)})
    criteria = tx.contains_any(text, lex.criteria)
    has = lambda c: F.size(c) > 0
    words = tuple(dict.fromkeys(w.lower() for _, _, ws in lex.topics for w in ws))
    asks = has("strong") | has("mandatory") | has("values") | criteria | (tx.contains_any(F.lower(text), words) & tx.contains_any(text, lex.verbs))
    marked = F.col("raw").rlike(MARKED)
    headed = (F.char_length(text) <= TITLE_CHARS) & ~text.rlike("[。；;！]$") & text.rlike(TITLE)
    kind = type_of(text, has("strong"), lex)
    front = F.col("raw").rlike(FRONT_ROW)
    reason = (
        F.when(F.col("nav") | tx.contains_any(text, lex.navigation), "navigation").when(text == "", "short")
        .when(~asks & F.coalesce(marked, F.lit(False)) & (F.char_length(text) >= LEAST_CHARS), "rescued").when(~asks, "heading").when(F.char_length(text) < LEAST_CHARS, "short")
        .when(~has("strong") & ~has("values") & ~criteria & headed & ~(F.coalesce(marked, F.lit(False)) & ~front), "heading")
        .when((kind == "OTHER") & ~has("strong") & ~criteria & binds_only(text, lex.buyers, lex.bidders), "procedural").otherwise("kept")
    )
    return each.withColumns({"criteria": criteria, "type": kind, "reason": reason, "clause": clause_number(text)})


def index(fragments: DataFrame, lex: Lexicon) -> DataFrame:
    """Requirements of each document: id, place, type, topic, risk, module, flags, words, clause, text, values, ids of folded repeats.

    Ids SR0001, SR0002, ... are given before repeats (same type and text without white space) fold into the first, so numbers may be
    missing; rescued clauses come after all others, unless their clause number has been kept already.
    """
    every = judged(fragments, lex).where("reason in ('kept', 'rescued')")
    known = F.bool_or((F.col("reason") == "kept") & (F.col("clause") != "")).over(Window.partitionBy("doc_id", "clause"))
    every = every.withColumn("known", known).where("reason = 'kept' or not known")
    late = (F.col("reason") == "rescued").cast("int")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(late, "pos", "k"))
    same = Window.partitionBy("doc_id", "type", "key")
    out = every.withColumns({"id": F.format_string("SR%04d", n), "n": n, "key": tx.squeezed(F.col("text"))})
    out = out.withColumns({"place": F.row_number().over(same.orderBy("n")), "ids": F.array_sort(F.collect_list(F.struct("n", "id")).over(same))})
    kind = F.col("type")
    return out.where("place = 1").select(
        "doc_id", "id", "pos", "k", "type", topic_of(kind, F.col("text"), lex).alias("topic"), _mapped(lex.risks, kind, "medium").alias("risk"), _mapped(lex.modules, kind, "document").alias("module"),
        (F.size("mandatory") > 0).alias("mandatory"), (F.size("strong") > 0).alias("high_risk"), F.slice(F.concat("strong", "mandatory"), 1, 12).alias("markers"),
        "clause", tx.clipped(F.col("text"), 600).alias("text"), "values", F.slice(F.transform("ids", lambda x: x["id"]), F.lit(2), F.size("ids")).alias("merged"),
    )


def stats(fragments: DataFrame, lex: Lexicon) -> DataFrame:
    """Per document: clauses looked at, kept, rescued, and dropped by reason."""
    count = lambda r: F.count_if(F.col("reason") == r).alias(r)
    return judged(fragments, lex).groupBy("doc_id").agg(F.count("*").alias("clauses"), *(count(r) for r in ("kept", "rescued", "navigation", "heading", "short", "procedural")))


def histogram(units: DataFrame, by: str) -> DataFrame:
    """How many requirements of each document have each value of a column."""
    return units.groupBy("doc_id", by).agg(F.count("*").alias("n"))


def mentions(rows: DataFrame, term: str) -> DataFrame:
    """Per document whether some fragment holds the term, whatever its case."""
    return rows.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.lower(tx.collapsed(F.col("text"))).contains(term.lower())), F.lit(False)).alias("found"))
