"""Evidence for review rules: every fragment scored against every rule, the best of a document kept, pruned, and summed up as a state.

Rules are a short list that callers pass in. What a fragment hits is worked out in its own row, so rules cost no join: the rules it
hits are exploded, and only then shuffled. Scores are rounded half up to three places.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import reduce
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as tx


class Rule(NamedTuple):
    id: str
    families: tuple[tuple[str, tuple[str, ...]], ...]
    module: str = ""
    focus: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()
    priority: tuple[str, ...] = ()
    exclusions: tuple[str, ...] = ()
    groups: tuple[tuple[str, ...], ...] = ()

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t for _, ts in self.families for t in ts))


class Words(NamedTuple):
    """Words that say something operative or of much information; modules whose headings count as evidence; what a scoring rule needs."""

    operative: tuple[str, ...] = ()
    informative: tuple[str, ...] = ()
    heading_modules: tuple[str, ...] = ()
    scoring_module: str = ""
    scoring: tuple[str, ...] = ()
    signals: tuple[str, ...] = ()


# What a term weighs, what each finding adds to the relevance, and the bounds of the band.
STAR, SHORT = 3.0, {"CA": 2.5, "U盘": 2.5, "光盘": 2.5}
CONTEXT, FAMILY, PRIORITY, HINT, POSITIVE, NEGATIVE, CELL = 0.35, 2.0, 4.0, 1.25, 2.0, 1.0, 0.75
OPERATIVE, CONTEXT_ONLY, HEADING = 1.5, -1.5, -3.0
TOP, LEAST, BAND, MOST, AMBIGUOUS, CONTEXT_LEAST = 40, 4.0, 5.0, 3, 3.5, 8.0


def weight(term: str) -> float:
    return STAR if term == "★" else SHORT.get(term, min(5.0, max(1.0, len(term) / 2.5)))


def _count(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (text.contains(w).cast("int") for w in words), F.lit(0))


def _weights(text: Column, words: tuple[str, ...], besides: Column | None = None) -> Column:
    seen = lambda w: text.contains(w) if besides is None else text.contains(w) & ~besides.contains(w)
    return reduce(lambda a, b: a + b, (F.when(seen(w), weight(w)).otherwise(0.0) for w in words), F.lit(0.0))


def _found(rule: Rule, words: Words) -> Column:
    """What a fragment (text, context, section) has of a rule, as a struct of counts and flags: each word is looked for once."""
    text, context, section = F.col("text"), F.col("context"), F.col("section")
    both = F.concat_ws("\n", text, context)
    strong = tuple(t for t in rule.terms if len(t) >= 3 or t in ("★", "CA"))
    grouped = reduce(lambda a, b: a & b, (tx.contains_any(text, g) for g in rule.groups), F.lit(True))
    return F.struct(
        F.lit(rule.id).alias("rule"), _weights(text, rule.terms).alias("direct"), _weights(context, rule.terms, text).alias("around"), _count(text, strong).alias("strong"),
        reduce(lambda a, b: a + b, (tx.contains_any(both, ts).cast("int") for _, ts in rule.families)).alias("families"), tx.hits(text, rule.focus).alias("focus"), _count(context, rule.focus).alias("beside"),
        F.lit(bool(rule.focus)).alias("focused"), tx.contains_any(section, rule.priority).alias("priority"), tx.contains_any(section, rule.hints).alias("hinted"), tx.contains_any(text, rule.positive).alias("positive"),
        tx.contains_any(text, rule.negative).alias("negative"), ((tx.contains_any(text, rule.exclusions) if not rule.groups else F.lit(False)) | ~grouped).alias("out"),
        F.lit(rule.module in words.heading_modules).alias("headed"), F.lit(rule.module != words.scoring_module or not words.scoring_module).alias("unscored"),
    )


def scored(rows: DataFrame, rules: list[Rule], words: Words, top: int = TOP) -> DataFrame:
    """The ``top`` best fragments of each document and rule: (doc_id, rule, place, pos, scores, eligible, text, section).

    ``rows`` has doc_id, pos, text and, if known, context (the row of a cell), section and kind (block or cell). Ties go to the
    document's order.
    """
    for c, v in (("context", ""), ("section", ""), ("kind", "block")):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v))
    every = F.array(*(_found(r, words) for r in rules))
    # The array is a column of its own: within the filter's expression generated code would not reach it.
    each = rows.where("text is not null").select("doc_id", "pos", "text", "section", F.col("kind").alias("_kind"), every.alias("_every"))
    each = each.select("doc_id", "pos", "text", "section", "_kind", F.explode(F.filter("_every", lambda x: (x["direct"] > 0) | (x["around"] > 0))).alias("x"))
    each = each.select("doc_id", "pos", "text", "section", "_kind", "x.*", tx.is_structural_heading(F.col("text")).alias("heading"), tx.contains_any(F.col("text"), words.operative).alias("operative"))
    c = F.col
    add = lambda flag, x: F.when(flag, x).otherwise(0.0)
    cell, alone, focus = c("_kind") == "cell", c("direct") == 0, F.size("focus")
    sharp = F.when(~c("focused"), 0.0).when(focus > 0, F.least(F.lit(4.0), 1.5 + 0.75 * focus)).when(c("beside") > 0, -0.75).otherwise(-3.0)
    relevance = (
        c("direct") + FAMILY * F.least(c("families"), F.lit(4)) + add(c("priority"), PRIORITY) + add(c("hinted"), HINT) + add(c("positive"), POSITIVE) + add(c("negative"), NEGATIVE) + add(cell, CELL)
        + sharp + add(c("operative"), OPERATIVE) + add(alone, CONTEXT_ONLY) + add(c("heading"), HEADING)
    )
    scores = each.withColumns({"retrieval": c("direct") + CONTEXT * c("around"), "relevance": relevance, "source": F.when(cell, 1.0).otherwise(0.75) + add(c("priority"), 2.0)})
    scores = scores.withColumn("final", F.round(c("retrieval") + c("relevance") + c("source"), 3))
    best = Window.partitionBy("doc_id", "rule").orderBy(F.desc("final"), "pos")
    kept = scores.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    # Whether a fragment may be evidence is asked of the best only.
    label = F.lit(False)
    for r in rules:
        if r.module not in words.heading_modules:
            label = label | ((c("rule") == r.id) & tx.is_bare_label(c("text"), list(words.operative), list(r.focus)))
    eligible = (
        (~c("heading") | c("headed")) & ~c("out") & (alone | ~(c("focused") & (focus == 0))) & (alone | (c("strong") > 0) | (c("families") >= 2)) & (~alone | (cell & (c("final") >= CONTEXT_LEAST)))
        & (c("final") >= LEAST) & (tx.contains_any(c("text"), words.scoring) | c("unscored")) & ~tx.is_navigation(c("text")) & ~label
    )
    rounded = [F.round(x, 3).alias(x) for x in ("retrieval", "relevance", "source")]
    return kept.select("doc_id", "pos", "text", "section", "rule", *rounded, "final", eligible.alias("eligible"), (~alone).alias("direct"), "families", "focus", "place")


def near_duplicate(a: str, b: str, contained: int = 18, alike: int = 28, ratio: float = 0.92) -> bool:
    """Equal, one inside the other with little besides, or alike by matching blocks; keys are without white space and punctuation."""
    if not a or not b:
        return False
    short, long = sorted((a, b), key=len)
    if a == b or len(short) >= contained and short in long:
        return len(long) - len(short) <= max(45, int(0.35 * len(long)))
    # Neither the lengths nor the characters in common, whatever their order, leave less than the matching blocks.
    both, least = len(a) + len(b), lambda n: 2.0 * n / both >= ratio
    return len(short) >= alike and least(len(short)) and least((Counter(a) & Counter(b)).total()) and SequenceMatcher(None, a, b).ratio() >= ratio


def contains_duplicate(a: Column, b: Column, contained: int = 18) -> Column:
    """The first two tests of near_duplicate() on keys, as an expression."""
    n, m = F.char_length(a), F.char_length(b)
    inside = (F.least(n, m) >= contained) & (F.contains(a, b) | F.contains(b, a)) & (F.abs(n - m) <= F.greatest(F.lit(45), F.floor(0.35 * F.greatest(n, m))))
    return (a != "") & (b != "") & ((a == b) | inside)


# Fates as codes, from 1 on the number of a choice.
WEAK, DUPLICATE, REDUNDANT = 0, -1, -2


def _fates(rows: list[tuple[float, str, list[str], bool]]) -> list[int]:
    """The codes of one document's fragments for a rule (final, key, focus, rich), which come best first."""
    seen: list[str] = []
    chosen: list[tuple[set[str], bool]] = []
    out = []
    for final, key, focus, rich in rows:
        own = set(focus)
        if any(near_duplicate(key, k) for k in seen):
            out.append(DUPLICATE)
            continue
        seen.append(key)
        if final < max(LEAST, rows[0][0] - BAND) or len(chosen) >= MOST:
            out.append(WEAK)
        elif all(own and f and rich and r and 2 * len(own & f) < min(len(own), len(f)) for f, r in chosen):
            chosen.append((own, rich))
            out.append(len(chosen))
        else:
            out.append(REDUNDANT)
    return out


def _codes(groups: pa.Array) -> pa.Array:
    sizes, each = pc.fill_null(pc.list_value_length(groups), 0).to_pylist(), groups.flatten()
    rows = zip(*(pc.struct_field(each, f).to_pylist() for f in ("final", "key", "focus", "rich")), strict=True)
    return pa.array([_fates(list(islice(rows, n))) for n in sizes], pa.list_(pa.int32()))


def pruned(top: DataFrame, words: Words) -> DataFrame:
    """Each eligible fragment's fate: kept (choice 1 to 3), duplicate, weak (out of the band or beyond three) or redundant.

    A second and third choice have to add something: another focus term (at most half in common with any chosen), at least 24
    characters, informative words, and another section or other words of focus. Greedy over at most ``TOP`` rows of one document and
    rule, which the window before has bounded: they become one array, and Python gets many arrays at once. A fragment alone needs none.
    """
    text = tx.collapsed(F.col("text"))
    rich = (F.char_length(text) >= 24) & tx.contains_any(text, words.informative)
    row = F.struct((-F.col("final")).alias("below"), F.col("pos").cast("int").alias("pos"), "final", tx.key(F.col("text")).alias("key"), "focus", rich.alias("rich"))
    groups = top.where("eligible").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), "rule").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    alone = F.array(F.when(F.col("rows")[0]["final"] < LEAST, WEAK).otherwise(1))
    several = F.size("rows") > 1
    codes = F.when(several, F.arrow_udf(_codes, "array<int>")(F.when(several, F.col("rows")))).otherwise(alone)
    each = groups.select("doc_id", "rule", F.explode(F.arrays_zip(F.col("rows.pos").alias("pos"), F.col("rows.final").alias("final"), codes.alias("code"))).alias("x")).select("doc_id", "rule", "x.*")
    code = F.col("code")
    fate = F.when(code == WEAK, "weak").when(code == DUPLICATE, "duplicate").when(code == REDUNDANT, "redundant").otherwise("kept")
    return each.select("doc_id", "rule", "pos", "final", F.greatest(code, F.lit(0)).alias("choice"), fate.alias("fate"))


def states(fates: DataFrame, top: DataFrame, keys: DataFrame, rules: list[Rule], rows: DataFrame, words: Words, elsewhere: tuple[str, ...] = ()) -> DataFrame:
    """A state for each document (key) and rule, and how many choices it has.

    FOUND or MULTIPLE_FOUND by the choices; without one NOT_APPLICABLE for the rules ``elsewhere`` in documents with an electronic
    signal, NEEDS_REVIEW where an ineligible fragment scores 3.5 or more, else NOT_FOUND.
    """
    kept = fates.where("fate = 'kept'").groupBy(F.col("doc_id").alias("key"), "rule").agg(F.count("*").alias("n"))
    doubt = top.where((F.col("final") >= AMBIGUOUS) & ~F.col("eligible")).select(F.col("doc_id").alias("key"), "rule", F.lit(True).alias("doubt")).distinct()
    signal = rows.groupBy(F.col("doc_id").alias("key")).agg(F.coalesce(F.bool_or(tx.contains_any(F.col("text"), words.signals)), F.lit(False)).alias("signal"))
    every = keys.select("key", F.explode(F.array(*(F.lit(r.id) for r in rules))).alias("rule"))
    out = every.join(kept, ["key", "rule"], "left").join(doubt, ["key", "rule"], "left").join(signal, "key", "left")
    no = F.coalesce(F.col("signal"), F.lit(False)) & (F.col("rule").isin(*elsewhere) if elsewhere else F.lit(False))
    state = F.when(F.col("n") == 1, "FOUND").when(F.col("n") > 1, "MULTIPLE_FOUND").when(no, "NOT_APPLICABLE").when(F.col("doubt"), "NEEDS_REVIEW").otherwise("NOT_FOUND")
    return out.select("key", "rule", F.coalesce("n", F.lit(0)).alias("choices"), state.alias("state"))


def retrieval_stats(state: DataFrame, top: DataFrame) -> DataFrame:
    """Per document: rules by state, hits, the mean and greatest score of the hits."""
    of = lambda s: F.count_if(F.col("state") == s)
    a = state.groupBy("key").agg(of("FOUND").alias("found"), of("MULTIPLE_FOUND").alias("several"), of("NEEDS_REVIEW").alias("review"), of("NOT_FOUND").alias("missing"))
    b = top.groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("hits"), F.round(F.avg("final"), 3).alias("mean"), F.max("final").alias("best"))
    return a.join(b, "key", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def own_section(section: Column, text: Column) -> Column:
    """The section unless its clause number is of another family than the text's own: neither is the other or a part of it."""
    number = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)^\s*[*★☆]?\s*([0-9]+(?:\.[0-9]+)*)", 1)
    a, b = number(text), number(section)
    kin = (a == b) | F.startswith(a, F.concat(b, F.lit("."))) | F.startswith(b, F.concat(a, F.lit(".")))
    return F.when((a == "") | (b == "") | kin, section).otherwise(F.lit(""))


def page_sections(rows: DataFrame) -> DataFrame:
    """Each fragment with its page's last heading, also before it: no heading is carried to another page."""
    last = F.max_by(F.when(tx.is_structural_heading(F.col("text")), F.col("text")), F.when(tx.is_structural_heading(F.col("text")), F.col("pos")))
    return rows.withColumn("section", F.coalesce(last.over(Window.partitionBy("doc_id", "page")), F.lit("")))
