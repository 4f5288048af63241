"""Boxes, lines and tables on pages: overlaps, merged segments, one-to-one matches, logical tables, running heads, format sections.

Every join is on the document and page, with the geometry as a residue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as tx


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals have in common."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def area(a: str, b: str) -> Column:
    """Area that two boxes (columns x0, y0, x1, y1 of two aliases) have in common."""
    return overlap(F.col(f"{a}.x0"), F.col(f"{a}.x1"), F.col(f"{b}.x0"), F.col(f"{b}.x1")) * overlap(F.col(f"{a}.y0"), F.col(f"{a}.y1"), F.col(f"{b}.y0"), F.col(f"{b}.y1"))


def inside(a: str, b: str, slack: float = 0) -> Column:
    """Whether the first box lies in the second, widened by ``slack``."""
    col = F.col
    return (col(f"{a}.x0") >= col(f"{b}.x0") - slack) & (col(f"{a}.y0") >= col(f"{b}.y0") - slack) & (col(f"{a}.x1") <= col(f"{b}.x1") + slack) & (col(f"{a}.y1") <= col(f"{b}.y1") + slack)


def owners(spans: DataFrame, slots: DataFrame) -> DataFrame:
    """Each span (page, id, box) with the slot (page, slot, box) of its page that covers most of it; ties go to the least slot. Null without one."""
    s, t = spans.alias("s"), slots.alias("t")
    met = s.join(t, (F.col("s.page") == F.col("t.page")) & (area("s", "t") > 0), "left")
    best = F.max_by(F.col("t.slot"), F.struct(area("s", "t").alias("a"), (-F.col("t.slot")).alias("n")))
    return met.groupBy(F.col("s.page").alias("page"), F.col("s.id").alias("id")).agg(F.when(F.max(F.col("t.slot")).isNotNull(), best).alias("slot"))


def grid_columns(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """Each cell (page, id, x0, x1) with the head column (page, col, x0, x1) that it overlaps most; ties go to the first column."""
    c, h = cells.alias("c"), heads.alias("h")
    width = overlap(F.col("c.x0"), F.col("c.x1"), F.col("h.x0"), F.col("h.x1"))
    met = c.join(h, (F.col("c.page") == F.col("h.page")) & (width > 0), "left")
    return met.groupBy(F.col("c.page").alias("page"), F.col("c.id").alias("id")).agg(F.max_by(F.col("h.col"), F.struct(width.alias("w"), (-F.col("h.col")).alias("n"))).alias("col"))


def merged_segments(segments: DataFrame, gap: float) -> DataFrame:
    """Segments (page, y, x0, x1) of one line that touch or lie within ``gap`` as one, with their number of parts (gaps and islands)."""
    order = Window.partitionBy("page", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("x0") - reach > gap), F.lit(True)).cast("int")
    runs = segments.withColumn("b", begins).withColumn("run", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("page", "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("parts")).drop("run")


def one_to_one(source: DataFrame, target: DataFrame, dy: float, dx: float) -> DataFrame:
    """(page, source, target): source lines (page, id, y, x0, x1) in order of id each take the nearest line left on their page.

    Near is |y| at most ``dy`` and both ends at most ``dx`` away; nearest by the sum of the three, then by id. What finds no line,
    on either side, comes with a null. Candidates are a join on page and a band of y; the choice, which hangs on those
    before it, is a fold over a page's lines.
    """
    s, t = source.alias("s"), target.alias("t")
    away = F.abs(F.col("s.y") - F.col("t.y")), F.abs(F.col("s.x0") - F.col("t.x0")), F.abs(F.col("s.x1") - F.col("t.x1"))
    met = s.join(t, (F.col("s.page") == F.col("t.page")) & (away[0] <= dy) & (away[1] <= dx) & (away[2] <= dx))
    near = F.struct((away[0] + away[1] + away[2]).cast("double").alias("d"), F.col("t.id").cast("bigint").alias("target"))
    found = met.groupBy(F.col("s.page").cast("bigint").alias("page"), F.col("s.id").cast("bigint").alias("source")).agg(F.array_sort(F.collect_list(near)).alias("near"))
    lines = found.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("source", F.transform("near", lambda x: x["target"]).alias("targets")))).alias("lines"))

    def take(acc: Column, x: Column) -> Column:
        free = F.get(F.array_except(x["targets"], acc["taken"]), F.lit(0))
        pair = F.struct(x["source"].alias("source"), free.alias("target"))
        return F.when(free.isNull(), acc).otherwise(F.struct(F.concat(acc["taken"], F.array(free)).alias("taken"), F.concat(acc["out"], F.array(pair)).alias("out")))

    none = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<struct<source:bigint,target:bigint>>").alias("out"))
    pairs = lines.select("page", F.explode(F.aggregate("lines", none, take, lambda a: a["out"])).alias("p")).select("page", "p.source", "p.target")
    lost = source.select(F.col("page").cast("bigint").alias("page"), F.col("id").cast("bigint").alias("source")).join(pairs, ["page", "source"], "left")
    new = target.select(F.col("page").cast("bigint").alias("page"), F.col("id").cast("bigint").alias("target")).join(pairs, ["page", "target"], "left_anti")
    return lost.unionByName(new.select("page", F.lit(None).cast("bigint").alias("source"), "target"))


def closure(matches: DataFrame) -> DataFrame:
    """Per page: source = matched + lost, generated = matched + invented."""
    s, t = F.col("source").isNotNull(), F.col("target").isNotNull()
    count = F.count_if
    return matches.groupBy("page").agg(count(s).alias("source"), count(t).alias("generated"), count(s & t).alias("matched"), count(s & ~t).alias("lost"), count(t & ~s).alias("invented"))


def consumed(source: DataFrame, painted: DataFrame, keys: list[str]) -> DataFrame:
    """Source rules with the painted rule that each consumes: equal keys, each painted rule once, both in order of id. Null if none is left."""
    n = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
    return n(source).withColumnRenamed("id", "source").join(n(painted).withColumnRenamed("id", "painted").select(*keys, "_n", "painted"), [*keys, "_n"], "left").drop("_n")


def table_bands(tables: DataFrame) -> DataFrame:
    """Per left and right edge (to a tenth) how far up and down tables of a document reach, and how many there are."""
    return tables.groupBy("doc_id", F.round("x0", 1).alias("left"), F.round("x1", 1).alias("right")).agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.count("*").alias("tables"))


def logical_tables(tables: DataFrame, height: float = 0.5, edge: float = 6.0, share: float = 0.05) -> DataFrame:
    """Table fragments with the logical table that they belong to (a running number in the document) and why each goes on.

    ``tables`` has doc_id, pos, page, page_height, x0, y0, x1, y1, columns (number), first_index and last_index (of items, or
    null), first_blank (whether the first row has no identity), last_open (whether the last text goes on) and repeats_head. A
    fragment goes on from the one before if pages are adjacent and equally high, the one before reaches its band's bottom and this
    one begins at its top, edges and columns agree, and either its first row is blank and the text goes on (WRAPPED_ROW) or item
    numbers go on without a new head (INDEX_RUN).
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    band = Window.partitionBy("doc_id", F.round("x0", 1), F.round("x1", 1))
    was = lambda c: F.lag(c).over(order)
    own = tables.withColumns({"top": F.min("y0").over(band), "bottom": F.max("y1").over(band)})
    tolerance = F.greatest(F.lit(edge), share * (F.col("bottom") - F.col("top")))
    apart = (F.col("page") == was("page") + 1) & (F.abs(F.col("page_height") - was("page_height")) <= height)
    cut = (was("y1") >= was("bottom") - tolerance) & (F.col("y0") <= F.col("top") + tolerance)
    grid = (F.abs(F.col("x0") - was("x0")) <= edge) & (F.abs(F.col("x1") - was("x1")) <= edge) & (F.col("columns") == was("columns"))
    wrapped = F.col("first_blank") & was("last_open")
    run = (F.col("first_index") == was("last_index") + 1) & ~F.col("repeats_head") & ~F.col("first_blank")
    why = F.when(F.coalesce(apart & cut & grid, F.lit(False)), F.when(F.coalesce(wrapped, F.lit(False)), "WRAPPED_ROW").when(F.coalesce(run, F.lit(False)), "INDEX_RUN"))
    out = own.withColumn("why", why).withColumn("begins", F.col("why").isNull().cast("int"))
    return out.withColumn("logical", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("top", "bottom", "begins")


def chrome(blocks: DataFrame, pages: DataFrame, share: float = 0.4) -> DataFrame:
    """Blocks (doc_id, page, text, y0, y1) that are a page's furniture: page numbers, and texts at the edge on 40 % of the pages (two at least).

    ``pages`` has doc_id, page, height.
    """
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    own = blocks.withColumn("key", tx.squeezed(F.col("text"))).where("key != ''")
    on = own.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("on"))
    at = own.join(on, ["doc_id", "key"]).join(n, "doc_id").join(pages.select("doc_id", "page", "height"), ["doc_id", "page"])
    edge = (F.col("y0") <= F.greatest(F.lit(100.0), 0.14 * F.col("height"))) | (F.col("y1") >= F.col("height") - F.greatest(F.lit(60.0), 0.1 * F.col("height")))
    number = F.col("key").rlike("^第?[0-9]+页?$")
    often = F.col("on") >= F.greatest(F.lit(2), F.ceil(share * F.col("n")))
    return at.where(number | (often & edge)).select("doc_id", "page", "text", F.when(number, "page number").otherwise("repeated").alias("reason"))


def body_frame(blocks: DataFrame) -> DataFrame:
    """Per document the median edges of its pages' bodies and the commonest distance between lines (to a tenth); ties go to the least."""
    page = blocks.groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    frame = page.groupBy("doc_id").agg(*(F.median(c).alias(c) for c in ("x0", "y0", "x1", "y1")), F.count("*").alias("pages"))
    step = F.round(F.col("y0") - F.lag("y0").over(Window.partitionBy("doc_id", "page").orderBy("y0")), 1)
    pitch = blocks.select("doc_id", step.alias("step")).where("step > 0").groupBy("doc_id", "step").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.min_by("step", F.struct((-F.col("n")).alias("n"), "step")).alias("pitch"))
    return frame.join(pitch, "doc_id", "left")


def format_sections(rows: DataFrame, titles: list[str], bare: int = 2) -> DataFrame:
    """Each document's format section: the best title (score, then the first), from its place to the next heading of its level or above.

    ``rows`` has doc_id, pos, text, level (of a heading, or null) and styled. A title counts 2, 4 more with a number before it and 5
    more in a heading's style. Confidence is 0.70 and a thirtieth of the score, at most 0.99.
    """
    number = r"(?U)^\s*(?:第[一二三四五六七八九十0-9]+[章节篇部分]|[0-9]+(?:\.[0-9]+)*[、.]?|[一二三四五六七八九十]+、)\s*"
    own = F.trim(F.regexp_replace("text", number, ""))
    score = F.when(own.isin(titles), bare + F.when(F.col("text").rlike(number), 4).otherwise(0) + F.when(F.col("styled"), 5).otherwise(0))
    best = rows.withColumn("score", score).where("score is not null").groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"), F.coalesce("level", F.lit(1)).alias("level"), "text")).alias("b"))
    starts = best.select("doc_id", (-F.col("b.p")).alias("start"), F.col("b.level").alias("own"), F.col("b.score").alias("score"), F.col("b.text").alias("title"))
    stops = rows.where("level is not null").join(starts, "doc_id").where("pos > start and level <= own").groupBy("doc_id").agg(F.min("pos").alias("stop"))
    return starts.join(stops, "doc_id", "left").select("doc_id", "title", "start", "stop", F.round(F.least(F.lit(0.99), 0.70 + F.col("score") / 30), 3).alias("confidence"))


def resolved_slots(slots: DataFrame, allowed: DataFrame, facts: DataFrame) -> DataFrame:
    """Each slot (doc_id, slot, kind, label, hint) with the fact that may fill it: by its label before its hint, if its kind allows the field.

    ``allowed`` has kind, field; ``facts`` doc_id, field, value, status. Statuses: FILLED, NOT_RESOLVED, NOT_ALLOWED, NO_FIELD. A unit
    that the hint names is not said twice at the value's end.
    """
    field = F.coalesce(F.nullif("label", F.lit("")), F.nullif("hint", F.lit("")))
    own = slots.withColumn("field", field)
    ok = own.join(F.broadcast(allowed.select("kind", "field", F.lit(True).alias("ok"))), ["kind", "field"], "left")  # a short fixed list
    both = ok.join(facts.select("doc_id", "field", "value", "status"), ["doc_id", "field"], "left")
    state = F.when(F.col("field").isNull(), "NO_FIELD").when(F.col("ok").isNull(), "NOT_ALLOWED").when(F.coalesce(F.col("status"), F.lit("")) != "RESOLVED", "NOT_RESOLVED").otherwise("FILLED")
    return both.select("doc_id", "slot", "field", F.when(state == "FILLED", F.col("value")).alias("value"), state.alias("state"))


def lines_of_blocks(lines: DataFrame, blocks: DataFrame, slack: float = 1.0) -> DataFrame:
    """Each line (page, line, box) with the block (page, block, box) that holds it, widened by ``slack``; of several the smallest, then the first."""
    s, b = lines.alias("s"), blocks.alias("b")
    size = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    met = s.join(b, (F.col("s.page") == F.col("b.page")) & inside("s", "b", slack), "left")
    return met.groupBy(F.col("s.page").alias("page"), F.col("s.line").alias("line")).agg(F.min_by(F.col("b.block"), F.struct(size.alias("z"), "b.block")).alias("block"))


def source_fragments(blocks: DataFrame, cells: DataFrame, tables: DataFrame, slack: float = 1.0) -> DataFrame:
    """Fragments of a document: blocks whose middle lies in no table of their page, and cells with their row as context, each place once.

    ``blocks`` has doc_id, page, pos, box, text; ``cells`` doc_id, page, table, row, col, pos, text; ``tables`` doc_id, page, box. Texts
    without characters are left out.
    """
    b, t = blocks.alias("b"), tables.alias("t")
    mid = lambda lo, hi: (F.col(f"b.{lo}") + F.col(f"b.{hi}")) / 2
    held = mid("x0", "x1").between(F.col("t.x0") - slack, F.col("t.x1") + slack) & mid("y0", "y1").between(F.col("t.y0") - slack, F.col("t.y1") + slack)
    free = b.join(t, (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page") == F.col("t.page")) & held, "left_anti")
    row = Window.partitionBy("doc_id", "page", "table", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    context = F.array_join(F.filter(F.transform(F.collect_list("text").over(row), lambda x: F.trim(x)), lambda x: x != ""), " | ")
    every = free.select("doc_id", "page", "pos", "text", F.lit("").alias("context"), F.lit("block").alias("kind")).unionByName(cells.select("doc_id", "page", "pos", "text", context.alias("context"), F.lit("cell").alias("kind")))
    first = Window.partitionBy("doc_id", "pos").orderBy("kind", "text")
    return every.where(tx.squeezed(F.col("text")) != "").withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
