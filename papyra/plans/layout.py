"""Geometry, facts, order and checks as queries on the standard tables, each beside its SQL. Inputs are written once, in words that both dialects read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import criticality as cr
from papyra.operators import evidence as ev
from papyra.operators import facts as fa
from papyra.operators import geometry as ge
from papyra.operators import invariants as iv
from papyra.operators import qa
from papyra.operators import requirements as rq
from papyra.operators import resolution as rs
from papyra.plans.catalog import _LINES, _read, _rows, query

_Q = dict[str, str]


def _made(spark: SparkSession, d: str, table: str, columns: _Q, where: str = "true") -> DataFrame:
    return _read(spark, d, table).where(where).selectExpr(*(f"{x} as {n}" for n, x in columns.items()))


def _sql(table: str, columns: _Q, where: str = "true") -> str:
    return f"SELECT {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM {table} WHERE {where}"


# Boxes: orders of odd keys are spans, of even keys slots, on a page for each customer.
_BOX = {"page": "o_custkey", "x0": "o_orderkey % 60", "x1": "o_orderkey % 60 + 10 + o_orderkey % 7", "y0": "o_orderkey % 40", "y1": "o_orderkey % 40 + 12"}
_SPAN, _SLOT = {"id": "o_orderkey", **_BOX}, {"slot": "o_orderkey", **_BOX}
_ODD, _EVEN = "o_orderkey % 2 = 1", "o_orderkey % 2 = 0"


@query(f"""WITH s AS ({_sql('orders', _SPAN, _ODD)}), t AS ({_sql('orders', _SLOT, _EVEN)}),
m AS (SELECT s.page, s.id, t.slot, greatest(least(s.x1, t.x1) - greatest(s.x0, t.x0), 0) * greatest(least(s.y1, t.y1) - greatest(s.y0, t.y0), 0) AS a FROM s JOIN t ON s.page = t.page),
b AS (SELECT * FROM m WHERE a > 0 QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY a DESC, slot) = 1) SELECT s.page, s.id, b.slot FROM s LEFT JOIN b ON b.page = s.page AND b.id = s.id""")
def slot_owners(spark: SparkSession, d: str) -> DataFrame:
    return ge.owners(_made(spark, d, "orders", _SPAN, _ODD), _made(spark, d, "orders", _SLOT, _EVEN))


_HEADC = {"col": "o_orderkey", "page": "o_custkey", "x0": "o_orderkey % 60", "x1": "o_orderkey % 60 + 10"}


@query(f"""WITH s AS ({_sql('orders', _SPAN, _ODD)}), t AS ({_sql('orders', _HEADC, _EVEN)}), m AS (SELECT s.page, s.id, t.col, least(s.x1, t.x1) - greatest(s.x0, t.x0) AS a FROM s JOIN t ON s.page = t.page),
b AS (SELECT * FROM m WHERE a > 0 QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY a DESC, col) = 1) SELECT s.page, s.id, b.col FROM s LEFT JOIN b ON b.page = s.page AND b.id = s.id""")
def head_columns(spark: SparkSession, d: str) -> DataFrame:
    return ge.grid_columns(_made(spark, d, "orders", _SPAN, _ODD), _made(spark, d, "orders", _HEADC, _EVEN))


_SEG = {"page": "l_orderkey % 500", "y": "l_partkey % 5", "x0": "l_suppkey * 7 % 900", "x1": "l_suppkey * 7 % 900 + l_quantity"}


@query(f"""WITH s AS ({_sql('lineitem', _SEG)}), r AS (SELECT *, max(x1) OVER (PARTITION BY page, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT page, y, min(x0) AS x0, max(x1) AS x1, count(*) AS parts FROM g GROUP BY page, y, run""")
def merged_segments(spark: SparkSession, d: str) -> DataFrame:
    return ge.merged_segments(_made(spark, d, "lineitem", _SEG), 2)


_RULE = {"page": "o_custkey", "id": "o_orderkey", "y": "o_orderkey % 9", "x0": "o_orderkey % 5", "x1": "o_orderkey % 5 + 20"}
_MATCH_SQL = f"""WITH RECURSIVE s AS ({_sql('orders', _RULE, _ODD)}), t AS ({_sql('orders', _RULE, _EVEN)}),
m AS (SELECT s.page, s.id AS source, t.id AS target, abs(s.y - t.y) + abs(s.x0 - t.x0) + abs(s.x1 - t.x1) AS d FROM s JOIN t ON s.page = t.page AND abs(s.y - t.y) <= 3 AND abs(s.x0 - t.x0) <= 2 AND abs(s.x1 - t.x1) <= 2),
c AS (SELECT page, source, list(target ORDER BY d, target) AS found, row_number() OVER (PARTITION BY page ORDER BY source) AS n FROM m GROUP BY page, source),
r AS (SELECT page, 1 AS n, source, found[1] AS target, [found[1]] AS taken FROM c WHERE n = 1
UNION ALL SELECT c.page, c.n, c.source, list_filter(c.found, lambda x: NOT list_contains(r.taken, x))[1], list_append(r.taken, list_filter(c.found, lambda x: NOT list_contains(r.taken, x))[1]) FROM r JOIN c ON c.page = r.page AND c.n = r.n + 1),
p AS (SELECT page, source, target FROM r WHERE target IS NOT NULL),
a AS (SELECT s.page, s.id AS source, p.target FROM s LEFT JOIN p ON p.page = s.page AND p.source = s.id UNION ALL SELECT t.page, NULL, t.id FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page = t.page AND p.target = t.id))"""


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return ge.one_to_one(_made(spark, d, "orders", _RULE, _ODD), _made(spark, d, "orders", _RULE, _EVEN), 3, 2)


@query(_MATCH_SQL + " SELECT page, source, target FROM a")
def one_to_one_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


@query(_MATCH_SQL + " SELECT page, count(source) AS source, count(target) AS generated, count(CASE WHEN source IS NOT NULL AND target IS NOT NULL THEN 1 END) AS matched, count(CASE WHEN target IS NULL THEN 1 END) AS lost, count(CASE WHEN source IS NULL THEN 1 END) AS invented FROM a GROUP BY page")
def match_closure(spark: SparkSession, d: str) -> DataFrame:
    return ge.closure(_matches(spark, d))


_KEYED = {"id": "o_orderkey", "page": "o_custkey", "kind": "o_orderstatus"}


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY page, kind ORDER BY id) AS n FROM ({_sql('orders', _KEYED, _ODD)})), t AS (SELECT *, row_number() OVER (PARTITION BY page, kind ORDER BY id) AS n FROM ({_sql('orders', _KEYED, _EVEN)}))
SELECT s.id AS source, s.page, s.kind, t.id AS painted FROM s LEFT JOIN t ON t.page = s.page AND t.kind = s.kind AND t.n = s.n""")
def consumed_rules(spark: SparkSession, d: str) -> DataFrame:
    return ge.consumed(_made(spark, d, "orders", _KEYED, _ODD), _made(spark, d, "orders", _KEYED, _EVEN), ["page", "kind"])


# Tables: a fragment for each order, in documents by customer; pages in steps of one or two.
_TABLE = {
    "doc_id": "o_custkey % 50", "pos": "o_orderkey", "page": "o_orderkey", "page_height": "CASE WHEN o_orderkey % 17 = 0 THEN 700.0 ELSE 842.0 END", "x0": "CAST(50 + o_custkey % 2 AS DOUBLE)", "x1": "CAST(500 AS DOUBLE)",
    "y0": "CASE WHEN o_orderkey % 5 = 0 THEN 200.0 ELSE 60.0 END", "y1": "CASE WHEN o_orderkey % 7 = 0 THEN 500.0 ELSE 800.0 END", "columns": "3 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END",
    "first_index": "o_orderkey * 3", "last_index": "o_orderkey * 3 + 2", "first_blank": "o_orderkey % 3 = 0", "last_open": "o_orderkey % 4 <> 0", "repeats_head": "o_orderkey % 11 = 0",
}


@query(f"""WITH t AS ({_sql('orders', {**_TABLE, 'doc_id': 'o_orderkey // 40'})}), w AS (SELECT *, min(y0) OVER (PARTITION BY doc_id, round(x0, 1), round(x1, 1)) AS tp, max(y1) OVER (PARTITION BY doc_id, round(x0, 1), round(x1, 1)) AS bt FROM t),
l AS (SELECT *, greatest(6.0, 0.05 * (bt - tp)) AS tol, lag(page) OVER o AS p_page, lag(page_height) OVER o AS p_h, lag(y1) OVER o AS p_y1, lag(bt) OVER o AS p_bt, lag(x0) OVER o AS p_x0, lag(x1) OVER o AS p_x1, lag(columns) OVER o AS p_c, lag(last_open) OVER o AS p_open, lag(last_index) OVER o AS p_li FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
y AS (SELECT *, CASE WHEN coalesce(page = p_page + 1 AND abs(page_height - p_h) <= 0.5 AND p_y1 >= p_bt - tol AND y0 <= tp + tol AND abs(x0 - p_x0) <= 6 AND abs(x1 - p_x1) <= 6 AND columns = p_c, false) THEN CASE WHEN first_blank AND p_open THEN 'WRAPPED_ROW' WHEN first_index = p_li + 1 AND NOT repeats_head AND NOT first_blank THEN 'INDEX_RUN' END END AS why FROM l)
SELECT doc_id, pos, why, CAST(sum(CASE WHEN why IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) - 1 AS logical FROM y""")
def logical_tables(spark: SparkSession, d: str) -> DataFrame:
    return ge.logical_tables(_made(spark, d, "orders", {**_TABLE, "doc_id": "o_orderkey div 40"})).select("doc_id", "pos", "why", "logical")


@query(f"""SELECT doc_id, round(x0, 1) AS "left", round(x1, 1) AS "right", min(y0) AS top, max(y1) AS bottom, count(*) AS tables FROM ({_sql('orders', _TABLE)}) GROUP BY 1, 2, 3""")
def table_bands(spark: SparkSession, d: str) -> DataFrame:
    return ge.table_bands(_made(spark, d, "orders", _TABLE))


_BLOCK = {"doc_id": "l_suppkey", "page": "l_partkey % 6"}
_BLOCK["text"] = "CASE WHEN l_linenumber = 1 THEN l_returnflag WHEN l_linenumber = 2 THEN concat('第', l_partkey % 6, '页') ELSE concat(l_returnflag, l_linestatus, l_orderkey) END"
_BLOCK["y0"], _BLOCK["y1"] = "CAST(l_linenumber * 120 - 60 AS DOUBLE)", "CAST(l_linenumber * 120 - 48 AS DOUBLE)"


@query(f"""WITH b AS ({_sql('lineitem', _BLOCK)}), p AS (SELECT DISTINCT doc_id, page, 842.0 AS height FROM b), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id), o AS (SELECT doc_id, text, count(DISTINCT page) AS m FROM b GROUP BY doc_id, text),
j AS (SELECT b.*, m, n, height, regexp_matches(text, '^第?[0-9]+页?$') AS number FROM b JOIN o USING (doc_id, text) JOIN n USING (doc_id) JOIN p USING (doc_id, page))
SELECT doc_id, page, text, CASE WHEN number THEN 'page number' ELSE 'repeated' END AS reason FROM j WHERE number OR (m >= greatest(2, ceil(0.4 * n)) AND (y0 <= greatest(100.0, 0.14 * height) OR y1 >= height - greatest(60.0, 0.1 * height)))""")
def page_chrome(spark: SparkSession, d: str) -> DataFrame:
    blocks = _made(spark, d, "lineitem", _BLOCK)
    return ge.chrome(blocks, blocks.select("doc_id", "page").distinct().withColumn("height", F.lit(842.0)))


_BODY = {"doc_id": "l_suppkey % 40", "page": "l_orderkey % 9", "x0": "CAST(l_quantity AS DOUBLE)", "y0": "CAST(l_partkey % 700 AS DOUBLE)", "x1": "CAST(l_quantity + 300 AS DOUBLE)", "y1": "CAST(l_partkey % 700 + 12 AS DOUBLE)"}


@query(f"""WITH b AS ({_sql('lineitem', _BODY)}), p AS (SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY doc_id, page), f AS (SELECT doc_id, median(x0) AS x0, median(y0) AS y0, median(x1) AS x1, median(y1) AS y1, count(*) AS pages FROM p GROUP BY doc_id),
s AS (SELECT doc_id, round(y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0), 1) AS step FROM b), c AS (SELECT doc_id, step, count(*) AS n FROM s WHERE step > 0 GROUP BY doc_id, step QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, step) = 1)
SELECT f.*, c.step AS pitch FROM f LEFT JOIN c ON c.doc_id = f.doc_id""")
def body_frames(spark: SparkSession, d: str) -> DataFrame:
    return ge.body_frame(_made(spark, d, "lineitem", _BODY))


_FORMAT = {"doc_id": "o_custkey", "pos": "o_orderkey", "text": "CASE o_orderkey % 9 WHEN 0 THEN '第三章 投标文件格式' WHEN 1 THEN '投标文件格式' WHEN 2 THEN '五、投标文件格式' WHEN 3 THEN '第四章 合同' WHEN 4 THEN '一、投标函' ELSE '正文见投标文件格式' END", "level": "CASE o_orderkey % 9 WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 END", "styled": "o_orderkey % 4 = 0"}


@query(f"""WITH r AS ({_sql('orders', _FORMAT)}), s AS (SELECT *, CASE WHEN text LIKE '正文%' OR text LIKE '%合同' OR text LIKE '%投标函' THEN NULL ELSE 2 + CASE WHEN text <> '投标文件格式' THEN 4 ELSE 0 END + CASE WHEN styled THEN 5 ELSE 0 END END AS score FROM r),
b AS (SELECT doc_id, text AS title, pos AS start, coalesce(level, 1) AS own, score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1)
SELECT b.doc_id, title, start, (SELECT min(pos) FROM r WHERE r.doc_id = b.doc_id AND r.level IS NOT NULL AND r.pos > b.start AND r.level <= b.own) AS stop, round(least(0.99, 0.70 + score / 30.0), 3) AS confidence FROM b""")
def format_sections(spark: SparkSession, d: str) -> DataFrame:
    return ge.format_sections(_made(spark, d, "orders", _FORMAT), ["投标文件格式"])


_SLOTS = {"doc_id": "o_custkey", "slot": "o_orderkey", "kind": "CASE WHEN o_orderkey % 2 = 0 THEN 'line' ELSE 'cell' END", "label": "CASE o_orderkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN '' END", "hint": "CASE o_orderkey % 5 WHEN 0 THEN 'segment' WHEN 1 THEN 'other' ELSE '' END"}
_ALLOWED = [("line", "name"), ("line", "segment"), ("cell", "segment"), ("cell", "other")]


@query(f"""WITH s AS ({_sql('orders', _SLOTS)}), f AS (SELECT c_custkey AS doc_id, 'name' AS field, c_name AS value, 'RESOLVED' AS status FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'RESOLVED' ELSE 'NEEDS_REVIEW' END FROM customer),
a(kind, field) AS (VALUES {', '.join(f"('{k}', '{f}')" for k, f in _ALLOWED)}), x AS (SELECT *, coalesce(nullif(label, ''), nullif(hint, '')) AS field FROM s)
SELECT x.doc_id, x.slot, x.field, CASE WHEN a.kind IS NOT NULL AND f.status = 'RESOLVED' THEN f.value END AS value, CASE WHEN x.field IS NULL THEN 'NO_FIELD' WHEN a.kind IS NULL THEN 'NOT_ALLOWED' WHEN coalesce(f.status, '') <> 'RESOLVED' THEN 'NOT_RESOLVED' ELSE 'FILLED' END AS state
FROM x LEFT JOIN a ON a.kind = x.kind AND a.field = x.field LEFT JOIN f ON f.doc_id = x.doc_id AND f.field = x.field""")
def filled_slots(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer")
    facts = c.selectExpr("c_custkey doc_id", "'name' field", "c_name value", "'RESOLVED' status").unionByName(c.selectExpr("c_custkey doc_id", "'segment' field", "c_mktsegment value", "CASE WHEN c_custkey % 2 = 0 THEN 'RESOLVED' ELSE 'NEEDS_REVIEW' END status"))
    return ge.resolved_slots(_made(spark, d, "orders", _SLOTS), spark.createDataFrame(_ALLOWED, "kind string, field string"), facts)


# Fragments of documents: lines as blocks, ten to a page.
_JOIN_SQL = f"""WITH RECURSIVE {_LINES}, b AS (SELECT doc_id, pos, pos // 10 AS page, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines),
o AS (SELECT *, coalesce(pos - lag(pos) OVER w <= 25 AND page - lag(page) OVER w <= 1 AND NOT regexp_matches(rtrim(lag(text) OVER w, ' '), '[。；;！!?]$'), false) AS goes FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, n, pos, page, 0 AS g, length(text) AS chars FROM o WHERE n = 1
UNION ALL SELECT o.doc_id, o.n, o.pos, o.page, CASE WHEN o.goes AND r.chars < 600 THEN r.g ELSE r.g + 1 END, CASE WHEN o.goes AND r.chars < 600 THEN r.chars + 1 + length(o.text) ELSE length(o.text) END FROM r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n + 1)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).withColumns({"page": F.expr("pos div 10"), "kind": F.lit("block")})


@query(_JOIN_SQL + ", t AS (SELECT r.*, b.text FROM r JOIN b ON b.doc_id = r.doc_id AND b.n = r.n) SELECT doc_id, CAST(max(pos) AS INT) AS pos, max(page) AS page, CAST(count(*) AS INT) AS fragments, sha256(string_agg(text, ' ' ORDER BY pos)) AS digest FROM t GROUP BY doc_id, g")
def joined_fragments(spark: SparkSession, d: str) -> DataFrame:
    return rq.assembled(_blocks(spark, d)).select("doc_id", "pos", "page", "fragments", F.sha2("text", 256).alias("digest"))


_EV = [
    ev.Rule("licence", (("licence", ("license", "licensed")), ("grant", ("under",))), focus=("licensed",), positive=("under",)), ev.Rule("table", (("table", (" | ",)),), focus=(" | ",)),
    ev.Rule("french", (("article", (" le ", " la ")), ("joint", (" et ",))), focus=(" et ",), negative=(" ne ",)), ev.Rule("german", (("article", (" der ", " die ")), ("joint", (" und ",))), focus=(" und ",), exclusions=("www",)),
]
_EW = ev.Words(operative=("must", " de ", " of "), informative=(" de ",))


def _score_sql(r: ev.Rule) -> str:
    has = lambda w: f"contains(text, '{w}')"
    some = lambda ws: " OR ".join(map(has, ws)) or "false"
    direct = " + ".join(f"CASE WHEN {has(t)} THEN {min(5.0, max(1.0, len(t) / 2.5))} ELSE 0.0 END" for t in r.terms)
    families = " + ".join(f"CASE WHEN {some(ts)} THEN 1 ELSE 0 END" for _, ts in r.families)
    focus = " + ".join(f"CASE WHEN {has(t)} THEN 1 ELSE 0 END" for t in r.focus)
    plus = f"2.0 * least({families}, 4) + CASE WHEN {some(r.positive)} THEN 2.0 ELSE 0 END + CASE WHEN {some(r.negative)} THEN 1.0 ELSE 0 END + CASE WHEN {focus} > 0 THEN least(4.0, 1.5 + 0.75 * ({focus})) ELSE -3.0 END + CASE WHEN {some(_EW.operative)} THEN 1.5 ELSE 0 END + CASE WHEN head THEN -3.0 ELSE 0 END"
    return f"SELECT '{r.id}' AS rule, doc_id, pos, round({direct}, 3) AS retrieval, round({direct} + {plus}, 3) AS relevance, round(2 * ({direct}) + {plus} + 0.75, 3) AS final FROM l WHERE {some(r.terms)}"


@query(rf"""WITH {_LINES}, l AS (SELECT *, regexp_matches(c, '^(第[0-9零〇一二三四五六七八九十百千万]+[章节篇部分条]|[一二三四五六七八九十百千万]+[、.．)]|[0-9]+(\.[0-9]+)*[、.．)])') AND length(c) <= 42 AND NOT regexp_matches(c, '[，。；;：:,]') AS head FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM lines)),
s AS ({' UNION ALL '.join(map(_score_sql, _EV))}) SELECT rule, doc_id, CAST(pos AS INT) AS pos, CAST(retrieval AS DOUBLE) AS retrieval, CAST(relevance AS DOUBLE) AS relevance, CAST(final AS DOUBLE) AS final, CAST(row_number() OVER (PARTITION BY doc_id, rule ORDER BY final DESC, pos) AS INT) AS place FROM s QUALIFY place <= 40""")
def evidence_scores(spark: SparkSession, d: str) -> DataFrame:
    return ev.scored(_rows(spark, d), _EV, _EW).select("rule", "doc_id", "pos", "retrieval", "relevance", "final", "place")


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, pos, replace(replace(replace(text, ' ', ''), '.', ''), ',', '') AS a, lead(replace(replace(replace(text, ' ', ''), '.', ''), ',', '')) OVER (PARTITION BY doc_id ORDER BY pos) AS n, pos % 3 AS m FROM lines),
q AS (SELECT doc_id, pos, a, CASE m WHEN 0 THEN n WHEN 1 THEN substr(a, 3) ELSE substr(a, 1, length(a) // 2) END AS b FROM p)
SELECT doc_id, CAST(pos AS INT) AS pos, coalesce(a <> '' AND b <> '' AND (a = b OR (least(length(a), length(b)) >= 18 AND (contains(a, b) OR contains(b, a)) AND abs(length(a) - length(b)) <= greatest(45, floor(0.35 * greatest(length(a), length(b)))))), false) AS near FROM q""")
def near_dup_contain(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    key = F.translate(F.col("text"), " .,", "")
    rows = _rows(spark, d).select("doc_id", "pos", key.alias("a"), F.lead(key).over(Window.partitionBy("doc_id").orderBy("pos")).alias("n"))
    b = F.when(F.col("pos") % 3 == 0, F.col("n")).when(F.col("pos") % 3 == 1, F.substring("a", 3, 1 << 30)).otherwise(F.left("a", F.expr("char_length(a) div 2")))
    return rows.select("doc_id", "pos", F.coalesce(ev.contains_duplicate(F.col("a"), b), F.lit(False)).alias("near"))


# Criticality, stages, risks and order of orders' line items.
_ATOM = {
    "doc_id": "l_orderkey", "atom": "l_linenumber", "marker": "l_partkey % 3 = 0", "means": "CASE l_suppkey % 3 WHEN 0 THEN 'SUBSTANTIVE' WHEN 1 THEN 'PROOF' ELSE '' END", "wording": "l_partkey % 11 = 0", "legal": "l_partkey % 13 = 0", "referred": "l_partkey % 17 = 0", "rejected": "l_partkey % 19 = 0",
}
_LEVEL_SQL = f"""a AS ({_sql('lineitem', _ATOM)}), c AS (SELECT *, CASE WHEN marker AND means = 'SUBSTANTIVE' THEN 'SOURCE_MARKER' WHEN wording THEN 'EXPLICIT_WORDING' WHEN legal THEN 'LEGAL_RULE' WHEN referred THEN 'REFERENCE' END AS basis FROM a),
v AS (SELECT *, CASE WHEN rejected THEN 'SUBSTANTIVE_REJECTION' WHEN basis IS NOT NULL THEN 'SUBSTANTIVE' WHEN marker AND means = 'PROOF' THEN 'MANDATORY' ELSE 'ORDINARY' END AS level FROM c)"""


@query(f"WITH {_LEVEL_SQL} SELECT doc_id, atom, basis, level FROM v")
def atom_criticality(spark: SparkSession, d: str) -> DataFrame:
    return cr.criticality(_made(spark, d, "lineitem", _ATOM)).select("doc_id", "atom", "basis", "level")


@query(f"""WITH {_LEVEL_SQL} SELECT doc_id, CASE min(CASE level WHEN 'SUBSTANTIVE_REJECTION' THEN 1 WHEN 'SUBSTANTIVE' THEN 2 WHEN 'MANDATORY' THEN 3 ELSE 4 END) WHEN 1 THEN 'SUBSTANTIVE_REJECTION' WHEN 2 THEN 'SUBSTANTIVE' WHEN 3 THEN 'MANDATORY' ELSE 'ORDINARY' END AS level, bool_or(rejected) AS rejects, count(*) AS atoms FROM v GROUP BY doc_id""")
def strongest_criticality(spark: SparkSession, d: str) -> DataFrame:
    return cr.strongest_of(cr.criticality(_made(spark, d, "lineitem", _ATOM)), ["doc_id"])


_ITEM = {
    "doc_id": "o_custkey", "id": "o_orderkey", "module": "o_orderpriority", "default": "CASE o_orderkey % 4 WHEN 0 THEN 'veto' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END", "decision": "o_orderkey % 7 = 0",
    "concern": "CASE WHEN o_orderkey % 10 = 0 THEN 'SCORING_PRICE' ELSE 'PRICE' END", "kind": "CASE o_orderkey % 3 WHEN 0 THEN 'CONTRACT_ONLY' WHEN 1 THEN 'MANDATORY' ELSE 'INFORMATIONAL' END", "text": "CASE WHEN o_orderkey % 2 = 0 THEN '投标文件中应承诺' ELSE '合同签订后' END",
    "consequence": "o_orderkey % 9 = 0", "level": "CASE o_orderkey % 5 WHEN 0 THEN 'SUBSTANTIVE_REJECTION' WHEN 1 THEN 'SUBSTANTIVE' WHEN 2 THEN 'ORDINARY' WHEN 3 THEN 'MANDATORY' END", "rejects": "o_orderkey % 5 = 0",
}
_ITEM_Q = {(f'"{k}"' if k == "default" else k): v for k, v in _ITEM.items()}
_STAGE_SQL = "CASE WHEN concern LIKE 'SCORING_%' THEN 'SCORING_RESPONSE' WHEN kind = 'CONTRACT_ONLY' AND NOT (contains(text, '应承诺') OR consequence) THEN 'CONTRACT_RISK_NOTICE' WHEN kind = 'INFORMATIONAL' THEN 'INFORMATIONAL' ELSE 'BID_RESPONSE' END"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").selectExpr(*(f"{x} as `{n}`" for n, x in _ITEM.items()))


@query(f"""WITH i AS ({_sql('orders', _ITEM_Q)}), s AS (SELECT *, {_STAGE_SQL} AS stage, CASE level WHEN 'SUBSTANTIVE_REJECTION' THEN 'veto' WHEN 'SUBSTANTIVE' THEN 'high' ELSE 'medium' END AS own FROM i)
SELECT id, stage, CASE WHEN stage = 'CONTRACT_RISK_NOTICE' THEN 'notice' WHEN stage = 'INFORMATIONAL' THEN 'low' WHEN level IS NULL THEN "default" WHEN rejects THEN 'veto' WHEN "default" = 'veto' THEN CASE WHEN own = 'medium' THEN 'high' ELSE own END
WHEN "default" = 'high' OR own = 'high' THEN 'high' WHEN "default" = 'medium' OR own = 'medium' THEN 'medium' ELSE 'low' END AS risk FROM s""")
def review_risks(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    staged = items.withColumn("stage", cr.stage(F.col("concern"), F.col("kind"), F.col("text"), "应承诺", F.col("consequence")))
    return staged.select("id", "stage", cr.risk(F.col("default"), F.col("level"), F.col("rejects"), F.col("stage")).alias("risk"))


_MODULES = ["1-URGENT", "3-MEDIUM", "2-HIGH"]


@query(f"""WITH i AS ({_sql('orders', _ITEM_Q)}) SELECT doc_id, id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE module WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END, CASE WHEN decision THEN 4 ELSE CASE "default" WHEN 'veto' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END END, id) AS INT) AS place FROM i""")
def review_order(spark: SparkSession, d: str) -> DataFrame:
    return cr.review_order(_items(spark, d), _MODULES).select("doc_id", "id", "place")


@query("""WITH f AS (SELECT o_custkey AS doc_id, o_orderpriority AS concern, min(o_orderkey) AS first FROM orders GROUP BY ALL), k AS (SELECT c_custkey AS doc_id, unnest(['5-LOW', '2-HIGH']) AS concern, unnest([1, 2]) AS ordinal FROM customer)
SELECT f.doc_id, f.concern, CAST(row_number() OVER (PARTITION BY f.doc_id ORDER BY ordinal IS NULL, ordinal, first, f.concern) AS INT) AS place FROM f LEFT JOIN k ON k.doc_id = f.doc_id AND k.concern = f.concern""")
def concern_order(spark: SparkSession, d: str) -> DataFrame:
    found = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("concern")).agg(F.min("o_orderkey").alias("first"))
    known = _read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.array(F.lit("5-LOW"), F.lit("2-HIGH"))).alias("p", "concern")).select("doc_id", "concern", (F.col("p") + 1).alias("ordinal"))
    return cr.stable_order(known, found)


# Facts from line items: each is a candidate of its order's document.
_CAND = {
    "doc_id": "l_orderkey", "field": "CASE WHEN l_partkey % 2 = 0 THEN 'unit' ELSE 'flag' END", "pos": "l_partkey * 10 + l_linenumber", "value": "CASE WHEN l_partkey % 2 = 0 THEN CASE WHEN l_suppkey % 5 = 0 THEN ' ' ELSE l_linestatus END ELSE l_returnflag END",
    "normalized": "CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN l_linestatus ELSE l_returnflag END", "method": "CASE l_linenumber % 4 WHEN 0 THEN 'keyword' WHEN 1 THEN 'same_line' WHEN 2 THEN 'title' ELSE 'next_line' END",
    "confidence": "CASE l_linenumber % 4 WHEN 0 THEN 0.70 WHEN 1 THEN 0.95 WHEN 2 THEN 0.60 ELSE 0.85 END", "rank": "l_suppkey % 3 * 10",
}
_FACT_SQL = f"""f AS ({_sql('lineitem', _CAND)}), u AS (SELECT *, normalized IS NOT NULL AS valid, method = 'keyword' AS word, (method = 'same_line' OR method = 'next_line') AS passes FROM f WHERE trim(value) <> ''),
w AS (SELECT doc_id, field, list(DISTINCT pos) FILTER (WHERE valid AND word) AS word_at FROM u GROUP BY doc_id, field),
g AS (SELECT u.doc_id, u.field, count(*) AS candidates, count(*) FILTER (WHERE valid) AS n, count(DISTINCT normalized) AS differ, min(confidence) AS least, min(confidence) FILTER (WHERE valid) AS least_valid, coalesce(bool_or(valid AND word), false) AS words,
count(*) FILTER (WHERE valid AND passes AND NOT list_contains(coalesce(word_at, []), pos)) AS support, count(*) FILTER (WHERE valid AND passes) AS passing FROM u JOIN w ON w.doc_id = u.doc_id AND w.field = u.field GROUP BY u.doc_id, u.field),
b AS (SELECT doc_id, field, value, confidence, rank FROM u WHERE valid QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY rank DESC, confidence DESC, pos, value DESC) = 1),
r AS (SELECT g.*, b.value, b.confidence AS c, b.rank, CASE WHEN n = 0 THEN 'no valid value' WHEN differ > 1 THEN 'values differ' WHEN words AND support = 0 THEN 'keyword alone' WHEN n = 1 AND passing = 0 THEN 'below the gate' WHEN n = 1 THEN 'one candidate' ELSE 'candidates agree' END AS reason FROM g LEFT JOIN b ON b.doc_id = g.doc_id AND b.field = g.field),
facts AS (SELECT doc_id, field, candidates, CASE WHEN reason IN ('one candidate', 'candidates agree') THEN value END AS value, CASE WHEN reason IN ('one candidate', 'candidates agree') THEN 'RESOLVED' ELSE 'NEEDS_REVIEW' END AS status,
CAST(CASE WHEN reason IN ('one candidate', 'candidates agree') THEN least(1.0, c + least(0.02, rank / 10000.0) + least(0.03, 0.01 * (n - 1))) WHEN reason = 'values differ' THEN least_valid ELSE least END AS DOUBLE) AS confidence, reason FROM r)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    fields = [fa.Field("unit", "text", ("单位",)), fa.Field("flag", "text", ("标志",))]
    c = _made(spark, d, "lineitem", _CAND).withColumn("confidence", F.col("confidence").cast("double"))
    return rs.resolve_fields(c, fields)


@query(f"WITH {_FACT_SQL} SELECT doc_id, field, candidates, value, status, round(confidence, 6) AS confidence, reason FROM facts")
def resolved_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("doc_id", "field", "candidates", "value", "status", F.round("confidence", 6).alias("confidence"), "reason")


@query(f"""WITH {_FACT_SQL}, k AS (SELECT o_orderkey AS key, unnest(['unit', 'flag', 'term']) AS field FROM orders), a AS (SELECT k.key, coalesce(status, 'NOT_FOUND') AS status FROM k LEFT JOIN facts ON facts.doc_id = k.key AND facts.field = k.field)
SELECT key, count(*) AS fields, count(*) FILTER (WHERE status = 'RESOLVED') AS resolved, count(*) FILTER (WHERE status = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (WHERE status = 'NOT_FOUND') AS not_found FROM a GROUP BY key""")
def fact_summary(spark: SparkSession, d: str) -> DataFrame:
    keys = _read(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return rs.summary(rs.dense(_facts(spark, d).withColumnRenamed("doc_id", "key"), keys, ["unit", "flag", "term"]))


_OVER = {"doc_id": "o_orderkey", "field": "CASE WHEN o_orderkey % 2 = 0 THEN 'unit' ELSE 'flag' END", "action": "CASE WHEN o_orderkey % 3 = 0 THEN 'KEEP' ELSE 'SELECT' END", "choice": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 5 END"}


@query(f"""WITH {_FACT_SQL}, p AS (SELECT doc_id, field, value, CAST(confidence AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY doc_id, field ORDER BY pos, value, method, rank) - 1 AS place FROM f), o AS ({_sql('orders', _OVER)}),
j AS (SELECT facts.*, o.action, p.value AS pv, p.confidence AS pc, CASE WHEN o.action IS NULL THEN NULL WHEN status <> 'NEEDS_REVIEW' THEN 'REFUSED' WHEN o.action = 'KEEP' THEN 'KEPT' WHEN trim(coalesce(p.value, '')) <> '' THEN 'SELECTED' ELSE 'INVALID' END AS outcome
FROM facts LEFT JOIN o ON o.doc_id = facts.doc_id AND o.field = facts.field LEFT JOIN p ON p.doc_id = facts.doc_id AND p.field = facts.field AND p.place = o.choice)
SELECT doc_id, field, CASE WHEN outcome = 'SELECTED' THEN pv ELSE value END AS value, CASE WHEN outcome = 'SELECTED' THEN 'RESOLVED' ELSE status END AS status, round(CASE WHEN outcome = 'SELECTED' THEN pc ELSE confidence END, 6) AS confidence, outcome FROM j""")
def overridden_facts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = _made(spark, d, "lineitem", _CAND).withColumn("confidence", F.col("confidence").cast("double"))
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "field").orderBy("pos", "value", "method", "rank")) - 1)
    out = rs.overridden(_facts(spark, d).select("doc_id", "field", "value", "status", "confidence"), c, _made(spark, d, "orders", _OVER))
    return out.withColumn("confidence", F.round("confidence", 6))


_TRUNC = {"doc_id": "o_custkey", "field": "'x'", "value": "CASE o_orderkey % 6 WHEN 0 THEN concat(o_orderpriority, ' of the whole project') WHEN 1 THEN o_orderpriority WHEN 2 THEN 'whole project' WHEN 3 THEN concat(o_orderpriority, ' x') WHEN 4 THEN 'abc' ELSE concat(o_orderpriority, ' or more') END", "normalized": "CAST(NULL AS VARCHAR(99))", "confidence": "CASE WHEN o_orderkey % 3 = 0 THEN 0.9 ELSE 0.8 END", "in_cell": "o_orderkey % 2 = 1", "id": "o_orderkey"}


@query(f"""WITH t AS ({_sql('orders', _TRUNC)}), x AS (SELECT *, replace(value, ' ', '') AS s, length(replace(value, ' ', '')) AS n FROM t)
SELECT doc_id, id FROM x a WHERE n < 4 OR NOT EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND ((b.n > a.n + 2 AND starts_with(b.s, a.s) AND b.confidence >= a.confidence)
OR (a.n > b.n + 2 AND a.n - b.n <= 32 AND starts_with(a.s, b.s) AND a.confidence < b.confidence) OR (a.n > b.n AND a.n - b.n <= 3 AND starts_with(a.s, b.s) AND a.confidence <= b.confidence AND a.in_cell AND regexp_matches(a.value, '\\s\\S{{1,3}}$'))
OR (2 * a.n <= b.n AND contains(b.s, a.s) AND a.confidence < b.confidence) OR (b.n > a.n AND ends_with(b.s, a.s) AND a.confidence <= b.confidence)))""")
def truncated_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rs.without_truncated(_made(spark, d, "orders", _TRUNC)).select("doc_id", "id")


_TIME = {"doc_id": "o_orderkey", "due": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('2026-01-', CASE WHEN o_orderkey % 2 = 0 THEN '05' ELSE '17' END) END", "open": "CASE o_orderkey % 4 WHEN 0 THEN '同投标截止时间' WHEN 1 THEN '同 提交响应文件 截止' WHEN 2 THEN '详见公告' ELSE '同投标时间' END"}


@query(f"""WITH t AS ({_sql('orders', _TIME)}) SELECT doc_id, CASE WHEN due IS NOT NULL AND doc_id % 4 IN (0, 1) THEN due END AS value, CASE WHEN due IS NOT NULL AND doc_id % 4 IN (0, 1) THEN 'RESOLVED' ELSE 'NEEDS_REVIEW' END AS status, CASE WHEN due IS NOT NULL AND doc_id % 4 IN (0, 1) THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS confidence FROM t""")
def derived_times(spark: SparkSession, d: str) -> DataFrame:
    t = _made(spark, d, "orders", _TIME)
    row = lambda f, v, s, c: t.select("doc_id", F.lit(f).alias("field"), v.alias("value"), v.alias("normalized"), s.alias("status"), F.lit(c).alias("confidence"), F.lit("").alias("reason"))
    due = row("due", F.col("due"), F.when(F.col("due").isNotNull(), "RESOLVED").otherwise("NEEDS_REVIEW"), 0.9)
    opening = row("open", F.lit(None).cast("string"), F.lit("NEEDS_REVIEW"), 0.95)
    candidates = t.select("doc_id", F.lit("open").alias("field"), F.lit(1).alias("pos"), F.col("open").alias("value"), F.lit(0.95).alias("confidence"))
    out = rs.derived(due.unionByName(opening), candidates, "open", "due", "同(?:投标|提交响应文件|响应文件递交|响应文件提交).{0,8}截止(?:时间)?")
    return out.where("field = 'open'").select("doc_id", "value", "status", "confidence")


@query(qa.SQL)
def delivery_checks(spark: SparkSession, d: str) -> DataFrame:
    return iv.checks(qa.on_tables({n: _read(spark, d, n) for n in ("orders", "customer", "lineitem", "part")}))


@query("""WITH c AS (SELECT o_orderstatus AS check_id, o_custkey AS doc_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'FAIL' WHEN o_orderpriority = '2-HIGH' THEN 'WARN' ELSE 'PASS' END AS status FROM orders)
SELECT doc_id, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'WARN') AS warned, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'PASS_WITH_REVIEW' ELSE 'PASS' END AS verdict FROM c GROUP BY doc_id""")
def qa_rollup(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "FAIL").when(F.col("o_orderpriority") == "2-HIGH", "WARN").otherwise("PASS")
    return qa.rollup(_read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), status.alias("status")))


@query("""SELECT l_returnflag AS code, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1""")
def violations_by_code(spark: SparkSession, d: str) -> DataFrame:
    return qa.by_code(_read(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_returnflag").alias("code")))


@query("""WITH k AS (SELECT unnest(['F', 'O', 'P', 'X']) AS kind) SELECT k.kind, count(o.o_orderkey) AS n FROM k LEFT JOIN orders o ON o.o_orderstatus = k.kind GROUP BY k.kind""")
def mismatch_buckets(spark: SparkSession, d: str) -> DataFrame:
    return qa.buckets(_read(spark, d, "orders").select(F.col("o_orderstatus").alias("kind")), ["F", "O", "P", "X"])


@query("SELECT o_custkey AS key, bool_and(o_totalprice > 1000) AS passed, count(*) AS parts FROM orders GROUP BY o_custkey")
def regression_cases(spark: SparkSession, d: str) -> DataFrame:
    return qa.all_pass(_read(spark, d, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_totalprice") > 1000).alias("ok")))


@query("""WITH p AS (SELECT o_custkey AS slot_group, o_orderkey AS slot FROM orders), a AS (SELECT o_custkey AS slot_group, o_orderkey AS slot FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_custkey, -o_orderkey FROM orders WHERE o_orderkey % 10 = 0),
j AS (SELECT coalesce(p.slot_group, a.slot_group) AS slot_group, p.slot AS planned, a.slot AS actual FROM p FULL JOIN a ON p.slot_group = a.slot_group AND p.slot = a.slot)
SELECT slot_group, count(planned) AS planned, count(actual) AS applied, count(*) FILTER (WHERE actual IS NULL) AS missing, count(*) FILTER (WHERE planned IS NULL) AS unplanned FROM j GROUP BY slot_group""")
def application_metrics(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders").select(F.col("o_custkey").alias("slot_group"), F.col("o_orderkey").alias("slot"))
    actual = o.where("slot % 3 != 0").unionByName(o.where("slot % 10 = 0").select("slot_group", (-F.col("slot")).alias("slot")))
    return qa.plan_and_actual(o, actual, "slot_group", "slot")


@query("""WITH c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 0), d AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0)
SELECT k, 'missing' AS why FROM c WHERE k NOT IN (SELECT k FROM d) UNION ALL SELECT k, 'unknown' FROM d WHERE k NOT IN (SELECT k FROM c)""")
def missing_and_unknown(spark: SparkSession, d: str) -> DataFrame:
    keys = _read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return qa.missing_unknown(keys.where("k % 4 != 0"), keys.where("k % 5 != 0"), "k")


@query(f"""WITH {_LINES}, w AS (SELECT doc_id, pos, length(text) AS n, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos) AS done FROM lines) SELECT doc_id, CAST(pos AS INT) AS pos, CAST(done - n AS BIGINT) AS top, CAST(done AS BIGINT) AS bottom FROM w""")
def reflow_positions(spark: SparkSession, d: str) -> DataFrame:
    return qa.stacked(_rows(spark, d).withColumn("height", F.char_length("text"))).select("doc_id", "pos", "top", "bottom")


_SHOWN = {"doc_id": "o_custkey", "id": "o_orderkey", "page": "o_orderkey % 20", "text": "concat(o_orderpriority, o_orderstatus)"}


@query(f"""WITH s AS ({_sql('orders', _SHOWN, _ODD)}), b AS ({_sql('orders', _SHOWN, _EVEN)}) SELECT doc_id, id FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = s.doc_id AND contains(b.text, substr(s.text, 1, 5)))""")
def ungrounded_rows(spark: SparkSession, d: str) -> DataFrame:
    shown = _made(spark, d, "orders", _SHOWN, _ODD).withColumn("text", F.left("text", F.lit(5)))
    return qa.ungrounded(shown, _made(spark, d, "orders", _SHOWN, _EVEN)).select("doc_id", "id")

