"""What leaves the engine: lines with their places, tables of results, and ledgers of what has come through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions import text as tx

#: Exit codes by status.
EXIT = {"PARSED": 0, "UNSUPPORTED_FORMAT": 2, "PARSE_ERROR": 3, "OCR_REQUIRED": 4}


def exit_code(status: Column) -> Column:
    """A status as an exit code; null for an unknown one."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in EXIT.items() for x in pair)), status)


def rendered_lines(items: DataFrame) -> DataFrame:
    """One line for each item with text, with its place before it: doc_id, pos, line.

    ``items`` has doc_id, pos, kind (pdf_block, pdf_table_cell, docx_paragraph, docx_table_cell), page, block, table, row, col, text.
    Line ends in a text are written as \\n. Cells of DOCX tables come without text too.
    """
    n = lambda c: F.col(c).cast("string")
    join = lambda *xs: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
    place = (
        F.when(F.col("kind") == "pdf_block", join("[PDF:P:", n("page"), ":B:", n("block"), "] ")).when(F.col("kind") == "pdf_table_cell", join("[PDF:T:", n("page"), ":T:", n("table"), ":R:", n("row"), ":C:", n("col"), "] "))
        .when(F.col("kind") == "docx_paragraph", join("[DOCX:P:", n("block"), "] ")).when(F.col("kind") == "docx_table_cell", join("[DOCX:T:", n("table"), ":R:", n("row"), ":C:", n("col"), "] "))
    )
    text = F.coalesce("text", F.lit(""))
    shown = items.where((text != "") | (F.col("kind") == "docx_table_cell"))
    return shown.select("doc_id", "pos", F.concat(place, F.replace(text, F.lit("\n"), F.lit("\\n"))).alias("line"))


def write_views(views: dict[str, DataFrame], target: str) -> None:
    """Each result as a table in a folder of ``target``, in place of what was there; tables of other names there, left by an earlier run, go."""
    spark = next(iter(views.values())).sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for name, view in views.items():
        view.write.mode("overwrite").parquet(f"{target}/{name}")
    for found in store.listStatus(at):
        if found.isDirectory() and found.getPath().getName() not in views:
            store.delete(found.getPath(), True)


def read_views(spark: SparkSession, target: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{target}/{n}") for n in names}


def missing_columns(views: dict[str, DataFrame], wanted: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(view, column) that a result should have and hasn't; a missing view lacks all."""
    return [(v, c) for v, columns in wanted.items() for c in columns if v not in views or c not in views[v].columns]


def mandatory(rows: DataFrame, types: tuple[str, ...], risks: tuple[str, ...]) -> DataFrame:
    """Rows that can gate a bid: marked, substantive or rejecting, or of a mandatory type or risk; never a notice of contract risk."""
    by_source = F.col("marked") | F.col("substantive") | F.col("rejects")
    return rows.where((F.col("stage") != "CONTRACT_RISK_NOTICE") & (by_source | F.col("type").isin(*types) | F.col("risk").isin(*risks)))


def exceptions(facts: DataFrame, checks: DataFrame) -> DataFrame:
    """What a reader has to look at: unresolved facts and checks that didn't pass, as (doc_id, kind, name, why)."""
    a = facts.where("status != 'RESOLVED'").select("doc_id", F.lit("fact").alias("kind"), F.col("field").alias("name"), F.col("status").alias("why"))
    return a.unionByName(checks.where("status != 'PASS'").select("doc_id", F.lit("check").alias("kind"), F.col("check_id").alias("name"), F.col("status").alias("why")))


def evidence_index(rows: DataFrame) -> DataFrame:
    """Excerpts (doc_id, page, excerpt) once each, numbered EV0001, ... by page and text, with the ids that cite them."""
    each = rows.where("trim(excerpt) != ''").withColumn("_k", tx.squeezed(F.col("excerpt"))).groupBy("doc_id", "page", "_k").agg(F.min("excerpt").alias("excerpt"), F.array_sort(F.collect_set("id")).alias("ids"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "_k"))
    return each.select("doc_id", F.format_string("EV%04d", n).alias("evidence"), "page", "excerpt", "ids")


def occurrences(text: Column, part: Column) -> Column:
    """How often a part stands in a text, without overlap; none of an empty part."""
    gone = F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))
    return F.when(part == "", 0).otherwise((gone / F.char_length(part)).cast("int"))


def text_ledger(atoms: DataFrame, delivered: DataFrame, least: int = 8) -> DataFrame:
    """Each source atom (doc_id, n, key) with its place in the delivered text (doc_id, key) and a note.

    Places are looked for forward from the one before, else from the beginning; MISSING without any. Of atoms of ``least``
    characters or more OUT_OF_ORDER is one found before the last such one's end, TOO_OFTEN one that the delivered text has
    more often than the source's own text. A document's atoms are folded in order; keys have no white space.
    """
    source = atoms.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("a"))
    both = source.join(delivered.withColumnRenamed("key", "_text"), "doc_id", "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    whole = F.array_join(F.transform("a", lambda x: x["key"]), "")

    def step(acc: Column, x: Column) -> Column:
        ahead = F.call_function("locate", x["key"], F.col("_text"), acc["at"])
        found = F.when(x["key"] == "", 0).when(ahead > 0, ahead).otherwise(F.call_function("locate", x["key"], F.col("_text"), F.lit(1)))
        long = F.char_length(x["key"]) >= least
        note = F.when(found == 0, "MISSING").when(long & (found < acc["last"]), "OUT_OF_ORDER").otherwise("")
        after = found + F.char_length(x["key"])
        row = F.struct(x["n"].cast("int").alias("n"), x["key"].alias("key"), found.cast("int").alias("place"), note.alias("note"))
        return F.struct(F.when(found > 0, after).otherwise(acc["at"]).cast("int").alias("at"), F.when(long & (found > 0), after).otherwise(acc["last"]).cast("int").alias("last"), F.concat(acc["out"], F.array(row)).alias("out"))

    none = F.array().cast("array<struct<n:int,key:string,place:int,note:string>>")
    rows = F.aggregate("a", F.struct(F.lit(1).alias("at"), F.lit(0).alias("last"), none.alias("out")), step, lambda s: s["out"])
    each = both.select("doc_id", "_text", whole.alias("_source"), F.explode(rows).alias("r"))
    often = (F.char_length("r.key") >= least) & (occurrences(F.col("_text"), F.col("r.key")) > occurrences(F.col("_source"), F.col("r.key")))
    return each.select("doc_id", "r.n", "r.place", F.when((F.col("r.note") == "") & often, "TOO_OFTEN").otherwise(F.col("r.note")).alias("note"))


def located(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Claims with the text of the item at their locator, of any kind: nulls in a locator's fields meet nulls."""
    fields = ["doc_id", "kind", "page", "block", "table", "row", "col"]
    c, i = claims.alias("c"), items.alias("i")
    on = F.col("c.doc_id") == F.col("i.doc_id")
    for f in fields[1:]:
        on = on & F.col(f"c.{f}").eqNullSafe(F.col(f"i.{f}"))
    return c.join(i, on, "left").select("c.*", F.col("i.text").alias("source"))


def judged_proposals(proposals: DataFrame, items: DataFrame, typed: Callable[[Column, Column], Column]) -> DataFrame:
    """Proposed values (doc_id, locator, field, value, evidence) with a verdict: accepted, or why not.

    The locator has to be there, its text to hold the evidence, the evidence the value (as it stands or by its comparison value),
    and the value to be one of its field. ``typed`` gives a field's and a text's comparison value. Accepted ones become candidates
    of method "proposal".
    """
    at = located(proposals, items)
    has = lambda a, b: F.coalesce(F.contains(tx.squeezed(a), tx.squeezed(b)) & (tx.squeezed(b) != ""), F.lit(False))
    value, evidence = F.col("value"), F.col("evidence")
    same = F.coalesce(typed(F.col("field"), value) == typed(F.col("field"), evidence), F.lit(False))
    verdict = (
        F.when(F.col("source").isNull(), "no such place").when(~has(F.col("source"), evidence), "evidence is not there").when(~has(evidence, value) & ~same, "value is not in the evidence")
        .when(typed(F.col("field"), value).isNull(), "no value of the field").otherwise("accepted")
    )
    return at.withColumn("verdict", verdict)


def schedule_atoms(decisions: DataFrame, atoms: DataFrame) -> DataFrame:
    """Deciding rows (doc_id, row_id, clause, page, value) with the first atom (doc_id, atom, clause, page, n, key) that already states them: same clause and page, the value in its text."""
    d, a = decisions.alias("d"), atoms.alias("a")
    page = F.col("d.page").isNull() | F.col("a.page").isNull() | (F.col("d.page") == F.col("a.page"))
    met = d.join(a, (F.col("d.doc_id") == F.col("a.doc_id")) & (F.col("d.clause") == F.col("a.clause")) & page & F.contains(F.col("a.key"), tx.squeezed(F.col("d.value"))), "left")
    return met.groupBy(F.col("d.doc_id").alias("doc_id"), F.col("d.row_id").alias("row_id")).agg(F.min_by(F.col("a.atom"), F.struct("a.n", "a.atom")).alias("atom"))


def best_tables(source: DataFrame, delivered: DataFrame) -> DataFrame:
    """Each source table (doc_id, table, token) with the delivered one (doc_id, target, text) that holds the greatest share of its tokens, and the share; ties go to the first."""
    own = source.where("token != ''")
    n = own.groupBy("doc_id", "table").agg(F.count("*").alias("n"))
    met = own.join(delivered, "doc_id").where(F.contains("text", "token")).groupBy("doc_id", "table", "target").agg(F.count("*").alias("k"))
    best = met.groupBy("doc_id", "table").agg(F.max(F.struct("k", (-F.col("target")).alias("t"))).alias("b"))
    return n.join(best, ["doc_id", "table"], "left").select("doc_id", "table", (-F.col("b.t")).alias("target"), F.round(F.coalesce("b.k", F.lit(0)) / F.col("n"), 4).alias("share"))


def clause_order(units: DataFrame, words: tuple[str, ...], sections: tuple[str, ...]) -> DataFrame:
    """Units (doc_id, id, text, section, values) with their place as evidence: words of the topic, no addresses, values, a section that counts, brevity, id."""
    low = F.lower("text")
    hits = sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    urls = occurrences(low, F.lit("http"))
    order = [hits.desc(), urls.asc(), (F.size("values") > 0).desc(), tx.contains_any(F.coalesce("section", F.lit("")), sections).desc(), F.char_length("text").asc(), F.col("id").asc()]
    return units.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def marker_occurrences(rows: DataFrame, marks: str = "*★▲◆●") -> DataFrame:
    """Marks before a clause (doc_id, pos, page, mark, clause, key), once for each page, place and text."""
    found = F.regexp_extract("text", rf"(?U)^\s*([{marks}])", 1)
    rest = F.regexp_replace("text", rf"(?U)^\s*[{marks}]\s*", "")
    clause = F.regexp_extract(rest, r"^([0-9]+(?:\.[0-9]+)+)", 1)
    each = rows.select("doc_id", "pos", "page", found.alias("mark"), clause.alias("clause"), tx.squeezed(rest).alias("key")).where("mark != ''")
    return each.dropDuplicates(["doc_id", "page", "pos", "key"])


def marker_evidence(occurrences_: DataFrame) -> DataFrame:
    """Occurrences folded into evidence: one for each clause, or text where there is no clause; the first stands for it."""
    by = F.when(F.col("clause") != "", F.col("clause")).otherwise(F.col("key"))
    return occurrences_.groupBy("doc_id", by.alias("about")).agg(F.min(F.struct("pos", "mark", "key")).alias("f"), F.count("*").alias("times")).select("doc_id", "about", "f.pos", "f.mark", "times")


def marker_meanings(rows: DataFrame, terms: list[tuple[str, tuple[str, ...]]], marks: str = "*★▲◆●") -> DataFrame:
    """What a document says its marks mean: of the statements that hold a mark and words of a meaning, the strongest (first in ``terms``). A mark without one says nothing."""
    each = rows.select("doc_id", "text", F.explode(F.array(*map(F.lit, marks))).alias("mark")).where(F.contains("text", "mark"))
    rank = F.lit(None).cast("int")
    for i, (_, words) in reversed(list(enumerate(terms))):
        rank = F.when(tx.contains_any(F.col("text"), words), i).otherwise(rank)
    best = each.withColumn("r", rank).where("r is not null").groupBy("doc_id", "mark").agg(F.min("r").alias("r"))
    return best.select("doc_id", "mark", F.element_at(F.array(*(F.lit(n) for n, _ in terms)), F.col("r") + 1).alias("means"))


def identity_columns(cells: DataFrame, filled: float = 0.5, short: float = 0.8, width: float = 0.5, chars: int = 12) -> DataFrame:
    """Columns (doc_id, table, col) that tell rows apart: filled in half of the rows, short in four fifths of these, and narrow, unless none is.

    ``cells`` has doc_id, table, row, col, text, width.
    """
    rows = cells.groupBy("doc_id", "table").agg(F.count_distinct("row").alias("rows"), F.max("width").alias("widest"))
    text = tx.squeezed(F.coalesce("text", F.lit("")))
    own = cells.groupBy("doc_id", "table", "col").agg(F.count_if(text != "").alias("n"), F.count_if((text != "") & (F.char_length(text) <= chars)).alias("s"), F.max("width").alias("w"))
    fit = own.join(rows, ["doc_id", "table"]).where((F.col("n") >= filled * F.col("rows")) & (F.col("n") > 0) & (F.col("s") >= short * F.col("n")))
    narrow = F.col("w") <= width * F.col("widest")
    return fit.withColumn("_narrow", narrow).withColumn("_some", F.bool_or("_narrow").over(Window.partitionBy("doc_id", "table"))).where("_narrow or not _some").select("doc_id", "table", "col")


def merged_ranges(cells: DataFrame) -> DataFrame:
    """Cells that share a box, as one range (first and last row and column); cells of their own box are no range."""
    box = ["x0", "y0", "x1", "y1"]
    own = cells.groupBy("doc_id", "table", *box).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("cells"))
    return own.where("cells > 1").select("doc_id", "table", "r0", "r1", "c0", "c1")


def vector_lines(drawings: DataFrame, thin: float = 1.5, least: float = 5.0) -> DataFrame:
    """Drawn boxes (page, id, box) as lines: horizontal or vertical if thin in one direction and long in the other; others are artwork."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kind = F.when((h <= thin) & (w >= least), "horizontal").when((w <= thin) & (h >= least), "vertical").otherwise("artwork")
    return drawings.withColumn("kind", kind)


def artwork_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("page").agg(F.count_if(F.col("kind") == "artwork").alias("artwork"), F.count("*").alias("drawings"))


def bold_by_stroke(traces: DataFrame, spans: DataFrame, dy: float = 0.6, share: float = 0.5) -> DataFrame:
    """Spans (page, id, x0, x1, y0) that are drawn in bold by a second, stroked pass: boxes filled and stroked at one place cover ``share`` of them.

    ``traces`` has page, mode (0 fills; 1 and 2 stroke), x0, x1, y0.
    """
    key = ["page", F.round("x0", 1).alias("a"), F.round("x1", 1).alias("b"), "y0"]
    fill, stroke = traces.where("mode = 0").select(*key).alias("f"), traces.where("mode in (1, 2)").select(*key).distinct().alias("s")
    drawn = stroke.join(fill, (F.col("s.page") == F.col("f.page")) & (F.col("s.a") == F.col("f.a")) & (F.col("s.b") == F.col("f.b")) & (F.abs(F.col("s.y0") - F.col("f.y0")) <= dy), "left_semi").alias("d")
    p = spans.alias("p")
    met = p.join(drawn, (F.col("p.page") == F.col("d.page")) & (F.abs(F.col("p.y0") - F.col("d.y0")) <= dy) & (F.col("d.a") < F.col("p.x1")) & (F.col("d.b") > F.col("p.x0")))
    over = F.least("p.x1", "d.b") - F.greatest("p.x0", "d.a")
    return met.groupBy(F.col("p.page").alias("page"), F.col("p.id").alias("id"), (F.col("p.x1") - F.col("p.x0")).alias("w")).agg(F.sum(over).alias("c")).where((F.col("w") > 0) & (F.col("c") >= share * F.col("w"))).select("page", "id")


def write_documents(items: DataFrame, target: str) -> None:
    """The items of rendered_lines() as two outputs in ``target``: ``normalized``, a JSON object for each document with its items in order, and ``lines``, a text file a document."""
    each = items.select("doc_id", F.struct(*(c for c in items.columns if c != "doc_id")).alias("item"))
    whole = each.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("item.pos").alias("p"), F.to_json("item").alias("j")))), lambda x: x["j"]).alias("items"))
    body = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"items":['), F.array_join("items", ","), F.lit("]}"))
    whole.select(body.alias("value")).write.mode("overwrite").text(f"{target}/normalized")
    lines = rendered_lines(items).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("value"))
    lines.write.mode("overwrite").partitionBy("doc_id").text(f"{target}/lines")
