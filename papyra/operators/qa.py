"""Checks of what is delivered: each is a frame of violations, empty if all is well, and counters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.operators import invariants as iv


def unsupported(facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Resolved facts (doc_id, field, value, status) of which no candidate with evidence has the value."""
    held = candidates.where("trim(evidence) != ''").select("doc_id", "field", "value").distinct()
    return facts.where("status = 'RESOLVED'").join(held, ["doc_id", "field", "value"], "left_anti")


def contradictory(facts: DataFrame) -> DataFrame:
    """Facts whose status and value don't go together: resolved without a value, or not found or in doubt with one."""
    return facts.where("(status = 'RESOLVED') != (value is not null)")


def leaked(facts: DataFrame, candidates: DataFrame, delivered: DataFrame, least: int = 4) -> DataFrame:
    """Unresolved facts one of whose candidates' texts, of at least ``least`` characters, stands in the field's delivered text."""
    open_ = facts.where("status != 'RESOLVED'").select("doc_id", "field")
    own = candidates.where(F.char_length(F.trim("value")) >= least).join(open_, ["doc_id", "field"]).select("doc_id", "field", "value")
    return own.join(delivered.select("doc_id", "field", "text"), ["doc_id", "field"]).where(F.contains("text", "value")).select("doc_id", "field").distinct()


def ungrounded(shown: DataFrame, source: DataFrame) -> DataFrame:
    """Rows (doc_id, id, text) whose text no source row (doc_id, text) of the document holds; an empty text is held by none."""
    s, t = shown.alias("s"), source.alias("t")
    return s.join(t, (F.col("s.doc_id") == F.col("t.doc_id")) & F.contains(F.col("t.text"), F.col("s.text")) & (F.col("s.text") != ""), "left_anti")


def lost_negation(rows: DataFrame, negations: tuple[str, ...]) -> DataFrame:
    """Rows (shown, source, notice) whose source denies something while the text shown doesn't; notices of contract risk are exempt."""
    return rows.where(~F.col("notice") & tx.contains_any(F.col("source"), negations) & ~tx.contains_any(F.col("shown"), negations))


def cut_lists(rows: DataFrame) -> DataFrame:
    """Texts that stop within a list: at a comma or an opening mark, or at a bare number of an item."""
    return rows.where(F.trim("text").rlike(r"(?:[、，,：:（(]|[（(]?[0-9]{1,2}[）)、.])$"))


def said_twice(rows: DataFrame, least: int = 24) -> DataFrame:
    """Texts in which a piece between marks of at least ``least`` characters comes twice."""
    pieces = F.filter(F.transform(F.split("text", "[。；;，,\n]"), lambda x: F.trim(x)), lambda x: F.char_length(x) >= least)
    return rows.where(F.size(pieces) > F.size(F.array_distinct(pieces)))


def mixed_stages(rows: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """Notices of contract risk that speak of rejection, or aren't of a notice's risk."""
    return rows.where("stage = 'CONTRACT_RISK_NOTICE'").where(tx.contains_any(F.col("text"), forbidden) | (F.col("risk") != "notice"))


def baseless_vetoes(rows: DataFrame, atoms: DataFrame) -> DataFrame:
    """Rows of veto risk (doc_id, id, risk) none of whose atoms (doc_id, id, scope) has a consequence for the response."""
    basis = atoms.where("scope = 'RESPONSE_REJECTION'").select("doc_id", "id")
    return rows.where("risk = 'veto'").join(basis, ["doc_id", "id"], "left_anti")


def uncovered(requirements: DataFrame, items: DataFrame) -> DataFrame:
    """Mandatory requirements (doc_id, id, mandatory) that no item (doc_id, requirement) takes up."""
    return requirements.where("mandatory").join(items.select("doc_id", F.col("requirement").alias("id")), ["doc_id", "id"], "left_anti")


def misplaced_evidence(evidence: DataFrame, fragments: DataFrame) -> DataFrame:
    """Evidence (doc_id, pos, page, excerpt) whose place isn't there, is on another page or lacks the excerpt, with the reason."""
    at = evidence.join(fragments.select("doc_id", "pos", F.col("page").alias("_page"), F.col("text").alias("_text")), ["doc_id", "pos"], "left")
    why = F.when(F.col("_text").isNull(), "no fragment").when(~F.col("page").eqNullSafe(F.col("_page")), "other page").when(~F.coalesce(F.contains(tx.squeezed(F.col("_text")), tx.squeezed(F.col("excerpt"))), F.lit(False)), "other text")
    return at.withColumn("why", why).where("why is not null").drop("_page", "_text")


def wrong_language(rows: DataFrame, share: float = 0.3) -> DataFrame:
    """Delivered texts in which fewer than ``share`` of the letters are Chinese; texts without letters pass."""
    letters = F.char_length(F.regexp_replace("text", r"(?U)[^\p{L}]", ""))
    own = F.char_length(F.regexp_replace("text", "[^一-鿿]", ""))
    return rows.where((letters > 0) & (own < share * letters))


def cut_tokens(rows: DataFrame) -> DataFrame:
    """Texts (text, source) that end within a number or word of Latin letters that goes on in the source."""
    at = F.instr(F.col("source"), F.col("text"))
    nxt = F.substring(F.col("source"), at + F.char_length("text"), F.lit(1))
    return rows.where((at > 0) & F.col("text").rlike("[0-9A-Za-z]$") & nxt.rlike("[0-9A-Za-z]"))


def absorbed_headings(rows: DataFrame) -> DataFrame:
    """Texts that end in a chapter's title which isn't theirs."""
    return rows.where(F.col("text").rlike(r"\S\s+第[一-龥0-9]{1,3}[章节篇部分条]\s*$"))


def unlike_headings(delivered: DataFrame, source: DataFrame) -> DataFrame:
    """Delivered headings (doc_id, text, level) that aren't a source heading of the same level, white space apart."""
    key = lambda df: df.select("doc_id", tx.squeezed(F.col("text")).alias("key"), "level")
    return key(delivered).join(key(source), ["doc_id", "key", "level"], "left_anti")


def two_surfaces(bindings: DataFrame) -> DataFrame:
    """Facts (doc_id, field) that are shown with more than one value."""
    return bindings.groupBy("doc_id", "field").agg(F.count_distinct("value").alias("values")).where("values > 1")


def ledger(rules: DataFrame) -> DataFrame:
    """Per document how many source rules there are and how many got through each step (canonical, applicable, delivered, visible); each step needs the one before."""
    steps, out, ok = ("canonical", "applicable", "delivered", "visible"), [F.count("*").alias("raw")], F.lit(True)
    for s in steps:
        ok = ok & F.coalesce(F.col(s), F.lit(False))
        out.append(F.count_if(ok).alias(s))
    return rules.groupBy("doc_id").agg(*out)


def scored_wrongly(rows: DataFrame) -> DataFrame:
    """Scoring factors (doc_id, factor, points, kind) with more than one ceiling, or tiers above it."""
    own = rows.groupBy("doc_id", "factor").agg(F.count_if(F.col("kind") == "MAX").alias("ceilings"), F.max(F.when(F.col("kind") == "MAX", F.col("points"))).alias("ceiling"), F.max(F.when(F.col("kind") == "TIER", F.col("points"))).alias("tier"))
    return own.where("ceilings > 1 or tier > ceiling")


# Counters.


def rollup(checks: DataFrame) -> DataFrame:
    """Per document how many checks failed or warned, and the verdict."""
    f, w = F.count_if(F.col("status") == "FAIL"), F.count_if(F.col("status") == "WARN")
    return checks.groupBy("doc_id").agg(f.alias("failed"), w.alias("warned"), F.when(f > 0, "FAIL").when(w > 0, "PASS_WITH_REVIEW").otherwise("PASS").alias("verdict"))


def by_code(violations: DataFrame) -> DataFrame:
    return violations.groupBy("code").agg(F.count("*").alias("n"))


def buckets(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """How many rows each of a fixed list of kinds has, none included."""
    every = rows.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return F.broadcast(every).join(rows.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def all_pass(rows: DataFrame) -> DataFrame:
    """Per case whether every part passes; a null is no pass."""
    return rows.groupBy("key").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("passed"), F.count("*").alias("parts"))


def plan_and_actual(planned: DataFrame, actual: DataFrame, group: str, key: str) -> DataFrame:
    """Per group how many were planned and applied, were planned only or applied only; keys are unique on each side."""
    tag = lambda df, p, a: df.select(group, key, F.lit(p).alias("p"), F.lit(a).alias("a"))
    each = tag(planned, 1, 0).unionByName(tag(actual, 0, 1)).groupBy(group, key).agg(F.max("p").alias("p"), F.max("a").alias("a"))
    return each.groupBy(group).agg(F.sum("p").alias("planned"), F.sum("a").alias("applied"), F.count_if(F.col("a") == 0).alias("missing"), F.count_if(F.col("p") == 0).alias("unplanned"))


def missing_unknown(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are expected but not found (missing), or found but not expected (unknown)."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("why", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("why", F.lit("unknown")))


def stacked(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, height) with the top and bottom that they get one under the other."""
    done = F.sum("height").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"bottom": done, "top": done - F.col("height")})


def flagged(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """How many rows have each flag, in one pass."""
    return rows.agg(*(F.count_if(c).alias(n) for n, c in flags.items()))


def on_tables(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The checks on tables of orders: an order's priority is a fact about its customer, line items are its candidates and atoms."""
    o, c, item = t["orders"], t["customer"], t["lineitem"]
    facts = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("flag").alias("field"), F.when(F.col("o_orderkey") % 4 != 0, F.lit("R")).alias("value"), F.when(F.col("o_orderkey") % 5 != 0, "RESOLVED").otherwise("NOT_FOUND").alias("status"))
    candidates = item.select(F.col("l_orderkey").alias("doc_id"), F.lit("flag").alias("field"), F.col("l_returnflag").alias("value"), F.when(F.col("l_linenumber") % 2 == 0, "seen").otherwise("").alias("evidence"))
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "veto").otherwise("notice").alias("risk"), F.when(F.col("o_orderkey") % 6 < 2, "CONTRACT_RISK_NOTICE").otherwise("BID_RESPONSE").alias("stage"), F.col("o_orderpriority").alias("text"))
    atoms = item.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("id"), F.when(F.col("l_returnflag") == "R", "RESPONSE_REJECTION").otherwise("").alias("scope"))
    return {
        "unsupported_facts": unsupported(facts, candidates), "contradictory_facts": contradictory(facts), "mixed_stages": mixed_stages(rows, ("URGENT",)), "baseless_vetoes": baseless_vetoes(rows, atoms),
        "two_surfaces": two_surfaces(item.select(F.col("l_orderkey").alias("doc_id"), F.lit("s").alias("field"), F.col("l_linestatus").alias("value"))),
        "orphan_orders": iv.orphans(o, "o_custkey", c, "c_custkey"), "repeated_customers": iv.repeats(c, "c_custkey"),
        "uncovered": uncovered(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("mandatory")), item.where("l_quantity > 40").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc_id"), F.col("l_orderkey").alias("requirement"))),
        "scored_wrongly": scored_wrongly(item.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("factor"), F.col("l_quantity").alias("points"), F.when(F.col("l_linenumber") == 1, "MAX").otherwise("TIER").alias("kind"))),
    }


SQL = """WITH f AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'R' END AS value, CASE WHEN o_orderkey % 5 <> 0 THEN 'RESOLVED' ELSE 'NOT_FOUND' END AS status FROM orders),
r AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'veto' ELSE 'notice' END AS risk, CASE WHEN o_orderkey % 6 < 2 THEN 'CONTRACT_RISK_NOTICE' ELSE 'BID_RESPONSE' END AS stage, o_orderpriority AS text FROM orders),
s AS (SELECT l_orderkey, l_suppkey, count(CASE WHEN l_linenumber = 1 THEN 1 END) AS c, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS m, max(CASE WHEN l_linenumber <> 1 THEN l_quantity END) AS t FROM lineitem GROUP BY ALL)
SELECT 'unsupported_facts' AS check_id, count(*) AS violations FROM f WHERE status = 'RESOLVED' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = f.doc_id AND l_returnflag = f.value AND l_linenumber % 2 = 0)
UNION ALL SELECT 'contradictory_facts', count(*) FROM f WHERE (status = 'RESOLVED') <> (value IS NOT NULL) UNION ALL SELECT 'mixed_stages', count(*) FROM r WHERE stage = 'CONTRACT_RISK_NOTICE' AND (contains(text, 'URGENT') OR risk <> 'notice')
UNION ALL SELECT 'baseless_vetoes', count(*) FROM r WHERE risk = 'veto' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = r.doc_id AND l_returnflag = 'R')
UNION ALL SELECT 'two_surfaces', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1) UNION ALL SELECT 'orphan_orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'repeated_customers', count(*) FROM (SELECT 1 FROM customer GROUP BY c_custkey HAVING count(*) > 1) UNION ALL SELECT 'uncovered', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)
UNION ALL SELECT 'scored_wrongly', count(*) FROM s WHERE c > 1 OR t > m"""
