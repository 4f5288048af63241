"""Each check finds its violation and passes what is right; odd rows of the operators on clauses and geometry."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.operators import concerns as cn
from papyra.operators import criticality as cr
from papyra.operators import evidence as ev
from papyra.operators import facts as fa
from papyra.operators import fragments as fr
from papyra.operators import geometry as ge
from papyra.operators import qa
from papyra.operators import requirements as rq
from papyra.operators import resolution as rs
from papyra.plans.clauses import LEXICON, RULES, WORDS

FACT, CAND = "doc_id int, field string, value string, status string", "doc_id int, field string, value string, evidence string"


def test_checks_find_and_pass(spark):
    make = spark.createDataFrame
    facts = make([(1, "a", "v", "RESOLVED"), (2, "a", "v", "RESOLVED"), (3, "a", None, "RESOLVED"), (4, "a", "v", "NEEDS_REVIEW"), (5, "a", None, "NEEDS_REVIEW")], FACT)
    cands = make([(1, "a", "v", "seen"), (2, "a", "v", " "), (5, "a", "long text", "seen")], CAND)
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    assert ids(qa.unsupported(facts, cands)) == [2, 3] and ids(qa.contradictory(facts)) == [3, 4]
    shown = make([(5, "a", "the long text here"), (1, "a", "v")], "doc_id int, field string, text string")
    assert ids(qa.leaked(facts, cands, shown)) == [5] and ids(qa.leaked(facts, cands, shown.where("doc_id = 1"))) == []
    rows = make([(1, "不按要求", "按要求", False), (2, "不按要求", "不按要求", False), (3, "不按要求", "按要求", True), (4, "按", "按", False)], "doc_id int, source string, shown string, notice boolean")
    assert ids(qa.lost_negation(rows, ("不",))) == [1]
    texts = make([(1, "一、甲，"), (2, "完整。"), (3, "见（1）"), (4, None), (5, "甲 第四条")], "doc_id int, text string")
    assert ids(qa.cut_lists(texts)) == [1, 3] and ids(qa.absorbed_headings(texts)) == [5]
    long = "一二三四五六七八九十一二三四五六七八九十一二三四"
    assert ids(qa.said_twice(make([(1, f"{long}。{long}"), (2, f"{long}。短。短"), (3, None)], "doc_id int, text string"))) == [1]
    stages = make([(1, "CONTRACT_RISK_NOTICE", "否决", "notice"), (2, "CONTRACT_RISK_NOTICE", "付款", "high"), (3, "CONTRACT_RISK_NOTICE", "付款", "notice"), (4, "BID_RESPONSE", "否决", "veto")], "doc_id int, stage string, text string, risk string")
    assert ids(qa.mixed_stages(stages, ("否决",))) == [1, 2]
    vetoes = make([(1, 1, "veto"), (2, 1, "veto"), (3, 1, "low")], "doc_id int, id int, risk string")
    assert ids(qa.baseless_vetoes(vetoes, make([(1, 1, "RESPONSE_REJECTION"), (2, 1, "SCORING_ONLY")], "doc_id int, id int, scope string"))) == [2]
    req = make([(1, 1, True), (1, 2, True), (1, 3, False)], "doc_id int, id int, mandatory boolean")
    assert [r.id for r in qa.uncovered(req, make([(1, 1)], "doc_id int, requirement int")).collect()] == [2]
    frs = make([(1, 0, 1, "some  text"), (1, 1, 2, "more")], "doc_id int, pos int, page int, text string")
    e = make([(1, 0, 1, "sometext"), (1, 0, 2, "some"), (1, 1, 2, "less"), (1, 9, 1, "x"), (1, 1, 2, None)], "doc_id int, pos int, page int, excerpt string")
    assert sorted(r.why for r in qa.misplaced_evidence(e, frs).collect()) == ["no fragment", "other page", "other text", "other text"]
    assert ids(qa.wrong_language(make([(1, "only English"), (2, "中文 text"), (3, "123")], "doc_id int, text string"))) == [1]
    cut = make([(1, "价格为12", "价格为1200元"), (2, "价格", "价格为"), (3, "12", "x"), (4, "abc", "abc def")], "doc_id int, text string, source string")
    assert ids(qa.cut_tokens(cut)) == [1]
    heads = make([(1, "第一章 总则", 1), (1, "第二章", 2)], "doc_id int, text string, level int")
    assert [r.key for r in qa.unlike_headings(heads, make([(1, "第一章总则", 1), (1, "第二章", 1)], "doc_id int, text string, level int")).collect()] == ["第二章"]
    assert [r.field for r in qa.two_surfaces(make([(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "b", "x")], "doc_id int, field string, value string")).collect()] == ["a"]
    rules = make([(1, True, True, False, True), (1, True, True, True, True), (1, None, True, True, True)], "doc_id int, canonical boolean, applicable boolean, delivered boolean, visible boolean")
    assert tuple(qa.ledger(rules).first()) == (1, 3, 2, 2, 1, 1)
    points = make([(1, 1, 5.0, "MAX"), (1, 1, 7.0, "TIER"), (1, 2, 5.0, "MAX"), (1, 2, 5.0, "TIER"), (2, 1, 5.0, "MAX"), (2, 1, 6.0, "MAX")], "doc_id int, factor int, points double, kind string")
    assert sorted((r.doc_id, r.factor) for r in qa.scored_wrongly(points).collect()) == [(1, 1), (2, 1)]
    assert tuple(qa.flagged(texts, {"nulls": F.col("text").isNull(), "all": F.lit(True)}).first()) == (1, 5)


ROWS = "doc_id bigint, pos int, text string, page int, kind string, section string, context string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(1, 0, None, 1, "block", None, None), (1, 1, "", 1, "block", "", ""), (None, 0, "投标人必须提交保证金5万元。", 1, "block", None, None), (2, 0, "x" * 100_000, None, "block", None, None), (2, 0, "x" * 100_000, None, "block", None, None)], ROWS)


def test_clause_operators_on_odd_rows(spark, odd):
    empty = odd.where("false")
    for rows, n in ((odd, 1), (empty, 0)):
        assert rq.index(rows, LEXICON).count() == n
        assert ev.scored(rows, RULES, WORDS).count() == n
        assert rq.assembled(rows).count() == (4 if n else 0)
    fields = [fa.Field("name", "text", ("项目名称",), multiline=True)]
    for f in (fa.same_line, fa.next_line, fa.multiline, fa.keyword):
        assert f(odd, fields).count() == f(empty, fields).count() == 0
    assert fr.whole_fragments(odd).count() == 4  # the empty text is a prefix of no other of its document
    assert cn.atoms(odd.withColumn("id", F.lit("SR1"))).where("doc_id = 2").count() == 2


def test_tiers_of_no_text(spark):
    """A null text has no list of tiers; an empty one, or one without tiers, has an empty list."""
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "1、只有一项得5分"), (3, "1、优得5分；2、良得3分")], "doc_id bigint, text string")
    got = {r.doc_id: r.t for r in rows.select("doc_id", cn.tiers(F.col("text")).alias("t")).collect()}
    assert got == {0: None, 1: [], 2: [], 3: [("优", "5分"), ("良", "3分")]}


def test_reached_cap_takes_up_no_more(spark):
    rows = spark.createDataFrame([(1, k, "y" * n, 1, "block") for k, n in enumerate((300, 299, 1, 5, 700, 2))] + [(2, 0, "a：", 1, "block"), (2, 1, "b。", 1, "block"), (2, 2, "c", 1, "block"), (2, 3, "d", 3, "block"), (2, 40, "e", 3, "block")], "doc_id bigint, pos int, text string, page int, kind string")
    got = sorted((r.doc_id, r.pos, r.fragments) for r in rq.assembled(rows).collect())
    assert got == [(1, 1, 2), (1, 4, 3), (1, 5, 1), (2, 1, 2), (2, 2, 1), (2, 3, 1), (2, 40, 1)]


def test_resolution(spark):
    fields = [fa.Field("x", "money", ("价",))]
    kind = "doc_id bigint, field string, pos int, value string, normalized string, method string, confidence double"
    rows = [(1, "x", 1, "5元", "5", "same_line", 0.95), (1, "x", 2, "6元", "6", "same_line", 0.95), (2, "x", 1, "5元", "5", "title", 0.6), (3, "x", 1, "5元", "5", "keyword", 0.7), (3, "x", 2, "5.0元", "5", "next_line", 0.85), (4, "x", 1, " ", None, "same_line", 0.95), (5, "x", 1, "约", None, "same_line", 0.95), (None, "x", 1, "5元", "5", "same_line", 0.95)]
    got = {r.doc_id: (r.status, r.value, r.reason) for r in rs.resolve_fields(spark.createDataFrame(rows, kind), fields).collect()}
    assert got == {1: ("NEEDS_REVIEW", None, "values differ"), 2: ("NEEDS_REVIEW", None, "below the gate"), 3: ("RESOLVED", "5", "candidates agree"), 5: ("NEEDS_REVIEW", None, "no valid value"), None: ("RESOLVED", "5", "one candidate")}
    assert rs.resolve_fields(spark.createDataFrame([], kind), fields).count() == 0
    ranks = [(100, "前附表 / 须知"), (60, "公告")]
    df = spark.createDataFrame([("投标人须知前附表",), ("招标公告",), ("正文",), (None,)], "s string")
    assert [r[0] for r in df.select(rs.source_rank(F.col("s"), ranks, 70)).collect()] == [100, 60, 70, 70]
    dup = spark.createDataFrame([(1, "A"), (1, "B"), (None, "C")], "key int, item string")
    clauses = spark.createDataFrame([(1, None), (2, 1), (None, 1), (9, 8)], "key int, parent int")
    assert sorted((str(r.key), r.item, r.via) for r in rs.with_parent(clauses, dup).collect()) == [("1", "A", "own"), ("2", "A", "parent"), ("9", None, "none"), ("None", "A", "parent")]


def test_geometry_on_odd_rows(spark):
    box = "page int, id int, y double, x0 double, x1 double"
    s, t = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0), (1, 2, 0.0, 0.0, 9.0), (2, 1, 0.0, 0.0, 9.0), (None, 5, 0.0, 0.0, 9.0)], box), spark.createDataFrame([(1, 7, 1.0, 0.0, 9.0), (1, 8, 0.5, 0.0, 9.0), (1, 9, 0.0, 90.0, 99.0)], box)
    got = sorted((str(r.page), str(r.source), str(r.target)) for r in ge.one_to_one(s, t, 2, 2).collect())
    assert got == [("1", "1", "8"), ("1", "2", "7"), ("1", "None", "9"), ("2", "1", "None"), ("None", "5", "None")]
    assert ge.one_to_one(s.where("false"), t.where("false"), 2, 2).count() == 0
    seg = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (1, 0.0, 5.5, 9.0), (1, 0.0, 20.0, 30.0), (1, 0.0, 1.0, 2.0), (1, 1.0, 0.0, 5.0)], "page int, y double, x0 double, x1 double")
    assert sorted((r.y, r.x0, r.x1, r.parts) for r in ge.merged_segments(seg, 1).collect()) == [(0.0, 0.0, 9.0, 3), (0.0, 20.0, 30.0, 1), (1.0, 0.0, 5.0, 1)]
    assert cr.schedule_rows(spark.createDataFrame([], "doc_id int, table int, row int, col int, page int, text string")).count() == 0


def test_fates_without_a_call_of_python_for_each_group(spark):
    """Many groups go to Python at once, a fragment alone doesn't need it, and each gets the fates of the plain greedy choice."""
    rng = random.Random(7)
    terms, long = ["保证金", "工期", "联合体", "必须"], "投标人按照本章规定的时间和方式向采购代理机构递交全部响应文件并且同时缴纳有关的费用"
    rows = []
    for doc in [None, -(2**53) - 1, *range(150)]:
        for rule in ("R1", "R2"):
            for pos in range(rng.choice([1, 1, 2, 5, 12])):
                base = rng.choice([long, long[::-1], "提交保证金", "。，", long[:20]])
                at = rng.randrange(len(base))
                text = rng.choice([base, f" {base}！", base[:at] + rng.choice(["工期", "x", ""]) + base[at + 1 :], base + rng.choice(terms) + base[:at]])
                rows.append((doc, rule, pos, text, round(rng.choice([3.5, 4.0, 6.0, 8.999, 9.0, rng.uniform(3, 12)]), 3), rng.sample(terms, rng.randrange(5)), rng.random() < 0.9))
    rng.shuffle(rows)
    top = spark.createDataFrame(rows, "doc_id bigint, rule string, pos int, text string, final double, focus array<string>, eligible boolean").withColumn("section", F.lit(""))
    fates = ev.pruned(top, WORDS)
    assert "FlatMapGroups" not in fates._jdf.queryExecution().executedPlan().toString()
    assert fates.dtypes == [("doc_id", "bigint"), ("rule", "string"), ("pos", "int"), ("final", "double"), ("choice", "int"), ("fate", "string")]

    def alike(a, b):
        short, whole = sorted((a, b), key=len)
        if a and b and (a == b or len(short) >= 18 and short in whole):
            return len(whole) - len(short) <= max(45, int(0.35 * len(whole)))
        return len(short) >= 28 and SequenceMatcher(None, a, b).ratio() >= 0.92

    want, groups = {}, defaultdict(list)
    keys = {(r.doc_id, r.rule, r.pos): (r.key, r.text) for r in top.select("doc_id", "rule", "pos", tx.key(F.col("text")).alias("key"), tx.collapsed(F.col("text")).alias("text")).collect()}
    for doc, rule, pos, _, final, focus, eligible in rows:
        if eligible:
            groups[doc, rule].append((-final, pos, set(focus), *keys[doc, rule, pos]))
    rich = lambda t: len(t) >= 24 and any(w in t for w in WORDS.informative)
    for (doc, rule), group in groups.items():
        seen, chosen = [], []
        best = -min(group, key=lambda x: x[:2])[0]
        for below, pos, own, key, text in sorted(group, key=lambda x: x[:2]):
            if any(alike(key, k) for k in seen):
                want[doc, rule, pos] = (0, "duplicate")
                continue
            seen.append(key)
            if -below < max(4.0, best - 5.0) or len(chosen) >= 3:
                want[doc, rule, pos] = (0, "weak")
            elif all(own and f and rich(text) and rich(t) and 2 * len(own & f) < min(len(own), len(f)) for f, t in chosen):
                chosen.append((own, text))
                want[doc, rule, pos] = (len(chosen), "kept")
            else:
                want[doc, rule, pos] = (0, "redundant")
    assert {f for _, f in want.values()} == {"kept", "weak", "duplicate", "redundant"} and max(n for n, _ in want.values()) > 1
    got = fates.collect()
    assert len(got) == len(want) and {(r.doc_id, r.rule, r.pos): (r.choice, r.fate) for r in got} == want
    assert ev.pruned(top.where("false"), WORDS).count() == 0
