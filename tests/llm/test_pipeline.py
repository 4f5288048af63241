"""Each stage of the corpus pipeline against a brute-force version on the rows that it gets."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from papyra.llm import quality
from papyra.llm.queries import tokenizer_path
from test_operators import SF, brute_components

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def ran(spark, tmp_path_factory, docs):
    """(stage, its input, its output) of each stage, written and read again."""
    out, at = [], tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{at}/{k}")
        then = spark.read.parquet(f"file://{at}/{k}")
        out.append((name, docs, then))
        docs = then
    return out


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    return {name: (a, b) for name, a, b in ran(spark, tmp_path_factory, spark.read.parquet(f"{SF}/documents.parquet"))}


def test_columns(spark, steps):
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    for _, b in list(steps.values())[:-1]:
        assert b.columns == want and b.count() > 0


def test_quality_stage(spark, steps):
    docs, kept = steps["quality classifier"]
    scores = {r.doc_id: r.score for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert rows(kept) == Counter(tuple(r) for r in docs.collect() if scores[r.doc_id] >= quality.ACCEPTED)


def test_line_stage(spark, steps):
    docs, out = steps["line dedup"]
    key = lambda line: line.strip(" \t\n\v\f\r").translate(_LOWER)
    holders = defaultdict(set)
    for r in docs.collect():
        for line in (r.text or "").split("\n"):
            holders[key(line)].add(r.doc_id)
    want = Counter()
    for r in docs.collect():
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or r.doc_id == max(holders[key(x)])]
        row = r.asDict()
        if len(kept) < len(lines):
            row["text"] = "\n".join(kept)
            row["n_chars"] = len(row["text"])
        want[tuple(row.values())] += 1
    assert rows(out) == want


def test_jaccard_stage(spark, steps):
    docs, out = steps["n-gram Jaccard join"]
    group = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(out) == Counter(tuple(r) for r in docs.collect() if group[r.doc_id][1] == r.doc_id)


def test_benchmark_stage(spark, steps):
    docs, out = steps["benchmark decontamination"]
    words = lambda t: tuple(_WORD.findall((t or "").translate(_LOWER)))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {w[k : k + 10] for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = words(text)
        return any(w[k : k + n] in windows for n in sizes for k in range(len(w) - n + 1))

    assert rows(out) == Counter(tuple(r) for r in docs.collect() if not hit(r.text))


def test_token_stage(spark, steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    docs, out = steps["BPE encoding and decoding"]
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[(*r, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert rows(out.select(*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_odd_rows(spark, tmp_path_factory):
    """Null and empty texts, rows without an id, repeated rows and a clashing column go through every stage; so does an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_words", F.lit("x"))
    odd = docs.limit(1).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), *docs.columns[2:])
    table = docs.unionByName(docs.orderBy("doc_id").limit(3)).unionByName(odd).unionByName(odd.withColumn("text", F.lit("")))
    last = ran(spark, tmp_path_factory, table)[-1][2]
    assert 0 < last.count() <= table.count() and "n_words" in last.columns
    assert ran(spark, tmp_path_factory, docs.where("false"))[-1][2].count() == 0


def test_jaccard_stage_repeated_ids(spark):
    """Of an id that comes again no text goes but near copies; the choice among equals doesn't hang on the order of rows."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    table = [(1, text(1), 10), (1, text(2), 11), (2, text(1).upper(), 12), (5, text(1), 13), (5, text(3), 14), (5, text(4), 16), (5, text(4), 15), (5, text(3) + " end", 17)]
    table += [(6, text(3), 18), (6, None, 19), (6, "", 20), (6, text(5), 21), (None, text(1), 22), (None, text(1), 23), (7, None, 24), (7, text(6), 25), (7, text(6).upper(), 26)]
    got = set()
    for rows_of in (table, table[::-1]):
        docs = spark.createDataFrame(rows_of, "doc_id bigint, text string, n_chars int").repartition(3)
        out = corpus_pipeline.one_of_each(spark, docs, SF).collect()
        got.add(tuple(sorted(r.n_chars for r in out)))
    assert len(got) == 1
    places = set(*got)
    assert places - {14, 17} == {10, 11, 15, 19, 21, 22, 23, 24, 26} and len(places & {14, 17}) == 1
