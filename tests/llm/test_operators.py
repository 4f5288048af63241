"""The corpus operators against brute-force versions, round trips and defined results for odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import bpe, decontam, fingerprint, htmltext, jaccard, langid, linededup, quality, tokencount, warc
from papyra.llm.common import scratch_dir
from papyra.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
LONG = "word salad, again and again; " * 20_000
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "é" * 50), (4, "é" * 50), (None, "a row without id"), (5, LONG), (6, "<|endoftext|> 日本 🤗 it's x  \n\n y"), (7, "One.\nTwo.\n")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id bigint, text string, n_words string, size int").cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def empty(docs):
    return docs.where("false")


def test_decontamination_paths_agree(spark, docs, odd):
    items = spark.createDataFrame([(1, "again; word salad"), (2, "again, word SALAD"), (3, None), (4, ""), (None, "two"), (1, "again; word salad")], "item_id bigint, text string")
    for d in (odd, docs):
        for b in (items, spark.read.parquet(f"{SF}/benchmark.parquet")):
            small = decontam.scan(d, b, cut=True)
            large = decontam.scan(d, b, cut=True, max_broadcast_bytes=-1)
            key = lambda r: str(r)
            assert sorted(map(key, small.collect())) == sorted(map(key, large.collect()))
    found = {r.doc_id: r for r in decontam.scan(odd, items, cut=True).collect()}
    assert found[1].n_words == 0 and not found[2].contaminated
    assert found[5].item_ids == ["1", "2"] and found[7].n_hit == 1 and found[7].n_items == 0
    assert found[7].cleaned == "One.\n.\n"
    assert decontam.scan(empty(odd), items).count() == 0
    kept = decontam.decontaminate(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, None, 6}


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontaminated_rows_are_judged_by_their_own_text(spark, remove):
    """Null and repeated ids with clean and contaminated texts, the benchmark broadcast and joined."""
    items = spark.createDataFrame([(1, "again; word salad"), (None, "two")], "item_id bigint, text string")
    table = [(None, "a clean row"), (None, "Word salad again, word salad"), (None, "another clean row"), (None, None), (None, ""), (1, "clean"), (1, "so: again word salad!"), (1, "clean"), (2, "one two three"), (2, "one two three"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, k, len(t or "")) for k, (i, t) in enumerate(table)], "doc_id bigint, text string, _hit int, n_chars int")
    cleaned = {1: "Word salad ", 6: "so: !", 8: "one  three", 9: "one  three"}
    if remove == "documents":
        want = [(i, t, k, len(t or "")) for k, (i, t) in enumerate(table) if k not in cleaned]
    else:
        want = [(i, cleaned.get(k, t), k, None if t is None else len(cleaned.get(k, t))) for k, (i, t) in enumerate(table)]
    for bound in (decontam.MAX_BROADCAST_BYTES, 0):
        out = decontam.decontaminate(docs, items, remove=remove, max_broadcast_bytes=bound)
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == want


def test_only_windows_that_pass_the_filter_are_joined(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = decontam.WindowFilter.of(items, 10, 1 << 20)
    hashes = decontam.WordHashes()
    for r in items.collect():
        w = decontam.words(r.text)
        own = decontam.rolled(hashes.array(w), min(10, len(w)))
        assert whole.hit(own, min(10, len(w))) == list(range(len(own)))
    passing = sum(len(whole.hit(decontam.rolled(hashes.array(decontam.words(r.text)), 10), 10)) for r in docs.collect())
    every = sum(max(0, len(decontam.words(r.text)) - 9) for r in docs.collect())
    assert 0 < passing < every / 20


def test_warc_round_trip(spark):
    page = "<p>" + "x" * 1000
    rows = [(1, "http://b.example.org/z", page), (2, "http://a.example.org/?q=1\n2", page), (3, None, None), (4, "", "short"), (5, "http://a.example.org/é", "short"), (2, "http://a.example.org/?q=1\n2", page), (None, "http://c.example", page)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archive = warc.Archive.write(pages, scratch_dir(spark, "t"))
    got = archive.records(payloads=True).collect()
    assert sorted(str((r.page_id, r.record_type, r.refers_to, r.payload_bytes)) for r in got) == sorted(map(str, [(1, "revisit", 2, 1003), (2, "response", None, 1003), (2, "response", None, 1003), (3, "response", None, 0), (4, "response", None, 5), (5, "response", None, 5), (None, "revisit", 2, 1003)]))
    assert all(r.payload_digest == hashlib.sha1(r.payload).hexdigest() for r in got if r.payload is not None)
    assert {r.page_id for r in archive.lookup(["http://a.example.org/é"]).collect()} == {5}
    assert {r.url for r in archive.lookup(["https://b.example.org/z#f", "http://none"]).collect()} == {"http://b.example.org/z"}
    assert warc.Archive.write(empty(pages), scratch_dir(spark, "t")).records().count() == 0
    assert warc.surt("http://user@www.a.org:81/p?q#f") == "org,a,www:81)/p?q"
    assert list(warc.search(["a", "c", "c", "e"], "c")) == [0, 1, 2]


def test_warc_lookup_searches_the_directory(spark):
    class Key(str):
        compared = 0

        def __lt__(self, other):
            Key.compared += 1
            return str.__lt__(self, other)

    firsts, lasts = [Key(f"{k:05}") for k in range(0, 20_000, 2)], [f"{k + 1:05}" for k in range(0, 20_000, 2)]
    assert warc.holding(firsts, lasts, [Key(x) for x in ("00000", "00007", "19999", "2", "")]) == [0, 3, 9_999]
    assert Key.compared <= 5 * 2 * 15
    assert warc.holding(["a", "c", "c", "c", "e"], ["c", "c", "c", "d", "f"], ["c"]) == [0, 1, 2, 3]
    rows = [(k, f"http://h{k % 7}.example/{k // 2 if k % 3 else 'same'}", f"p{k}") for k in range(4_000)]  # keys within a block and over several
    archive = warc.Archive.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), scratch_dir(spark, "t"))
    assert archive.directory.count() >= 8
    for urls in ([rows[0][1]], [rows[5][1], rows[3_999][1], rows[3][1]], ["http://none.example/"], [], [u for _, u, _ in rows]):
        assert sorted(r.page_id for r in archive.lookup(urls).collect()) == [k for k, u, _ in rows if u in urls]
    hot = spark.createDataFrame([(k, "http://one.example/" if k % 3 else None, "x") for k in range(3_000)], "page_id bigint, url string, offset string")
    archive = warc.Archive.write(hot.withColumn("html", F.lit(None).cast("string")), scratch_dir(spark, "t"))
    assert archive.find(hot.select("url")).count() == 3_000 and archive.lookup(["http://one.example/"]).count() == 2_000


def test_warc_reads_near_ranges_at_once(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 5)
    monkeypatch.setattr(warc, "SPAN", 30)
    places = [("a", 0, 10), ("a", 10, 10), ("a", 25, 3), ("a", 28, 10), ("a", 60, 1), ("b", 61, 100), ("b", 161, 1)]
    assert list(warc.runs_of(places)) == [("a", 0, [(0, 10), (10, 10), (25, 3)]), ("a", 28, [(28, 10)]), ("a", 60, [(60, 1)]), ("b", 61, [(61, 100)]), ("b", 161, [(161, 1)])]
    assert list(warc.runs_of([])) == []


def test_language(spark, docs, odd):
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.93
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in out)
    got = langid.identify(odd.withColumn("lang", F.lit("zz")))
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ODD) and by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[5].lang_pred == "zz"
    assert langid.identify(empty(odd).withColumn("lang", F.lit("zz"))).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(jaccard._LOWER).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in where[x]).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in s:
            where[x].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard(spark, docs, odd):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for g in range(6):  # groups of near copies around the threshold
        base = [f"w{g}x{k}" for k in range(60)]
        for c in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(60)] = f"e{rng.random()}"
            rows.append((10_000 + 100 * g + c, " ".join(own)))
    rows += [(20_000, "A b"), (20_001, "a  B"), (20_002, "a b c")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(table).collect()} == brute_components(rows)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (None, 1, None)} <= got
    assert jaccard.link(odd).count() == len(ODD) and jaccard.link(empty(odd)).count() == 0


def test_bpe_and_tokens(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for d in (docs, odd):
        texts = [r.text or "" for r in d.collect()]
        want = Counter((tuple(x.ids), t.decode(x.ids, skip_special_tokens=False)) for x in t.encode_batch(texts, add_special_tokens=False))
        got = bpe.encode_table(d, tokenizer_path())
        assert got.columns == [*d.columns, "_ids", "_decoded"]
        assert Counter((tuple(np.frombuffer(r._ids, "<u4").tolist()), r._decoded) for r in got.collect()) == want
        counted = tokencount.section_counts(d, tokenizer_path()).collect()
        lines = Counter()
        for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
            if x.isascii() and "<|" not in x:
                starts = [0, *(k + 1 for k, c in enumerate(x) if c == "\n" and k + 1 < len(x))]
                own = np.bincount([np.searchsorted(starts, a, "right") - 1 for a, _ in e.offsets], minlength=len(starts)) if e.offsets else [0] * len(starts)
                lines[tuple(int(v) for v in own)] += 1
        assert not lines - Counter(tuple(r.section_tokens) for r in counted)
        assert all(sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections for r in counted)
    b = bpe.Bpe(bpe.spec(tokenizer_path()))
    for x in ["aaaaaaa" * 999, "  a", " \n b", "\t\t x", "a 　 b", "x\x85 y"]:
        assert np.frombuffer(b.encode([x])[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert bpe.encode_table(empty(odd), tokenizer_path()).count() == 0


def test_long_texts_are_encoded_in_segments(monkeypatch):
    b = bpe.Bpe(bpe.spec(tokenizer_path()))
    texts = ["word salad  again 日本 " * 40 + "x" * 300 + "\n\n  y<|endoftext|> z", " a" * 500, "no blank" + "q" * 400, "", " "]
    whole = b.encode(texts)
    for size in (1, 7, 100):
        monkeypatch.setattr(bpe, "LONG", size)
        assert b.encode(texts) == whole and ["".join(b.segments(t)) for t in texts] == texts


def test_line_dedup(spark, odd):
    common = "This line is long enough to be counted, É."
    rows = [(i, f"own {i}\n  {common.upper().replace('É', 'É')}\t\nend") for i in range(1, 7)] + [(8, common), (8, common), (9, None), (None, common), (10, "é" * 40), (11, "short\n" * 9)]
    out = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_id", F.lit(1)), lines="_lines").collect()}
    assert [out[i]._dropped for i in (1, 6, 8, 9, None, 10, 11)] == [1, 1, 0, 0, 0, 0, 0]
    assert out[1]._kept == "own 1\nend" and out[9]._kept == "" and out[9]._lines == 1 and out[None]._kept == common
    assert linededup.dedup(odd).count() == len(ODD) and linededup.dedup(empty(odd)).count() == 0


def test_line_runs(spark):
    """Keys are parted into new and known ones batch by batch; no two runs share a key, and counts add up through compactions."""
    runs = linededup.LineRuns(spark, fan=2)
    batch = lambda ids: spark.createDataFrame([(i, h, 0) for i in ids for h in (7, i)], "doc_id bigint, h1 bigint, h2 bigint")
    for ids in ([1, 2], [3], [4, 5], [6]):
        runs.add(batch(ids))
        keys = [r.h1 for run in runs for r in run.collect()]
        assert len(keys) == len(set(keys))
    assert sorted(h for run in runs for h in [r.h1 for r in run.collect()]) == [1, 2, 3, 4, 5, 6, 7]
    assert [(r.h1, r.n, r["last"]) for r in runs.frequent(5).collect()] == [(7, 6, 6)]
    assert {r.h1 for r in runs.unseen(spark.createDataFrame([(7, 0, 1, 1), (9, 0, 1, 1)], linededup.RUN)).collect()} == {9}
    plan = runs.unseen(runs._store(spark.createDataFrame([(9, 0, 1, 1)], linededup.RUN)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in plan


def test_line_dedup_needs_the_anti_join(spark, monkeypatch):
    """Without it a key known from earlier batches counts in pieces, and lines stay."""
    text = "This line is long enough to be counted in all batches."
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id bigint, text string")
    total = lambda: sum(r._dropped for r in linededup.dedup(docs, min_docs=20).collect())
    assert total() == 39
    monkeypatch.setattr(linededup.LineRuns, "unseen", lambda self, batch: batch)
    assert total() != 39


def test_fingerprints(spark, docs, odd):
    a, b = fingerprint.Prefixes("xxabcdefg"), fingerprint.Prefixes("abcdefh")
    assert a.extension(2, b, 0) == 6 and a.span(2, 5) == b.span(0, 3) != b.span(1, 4)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    after = [t for _, t in rows[1:]] + [rows[0][1]]
    want = {i: hashlib.sha256(fingerprint.edited(t, n).encode()).hexdigest() for (i, t), n in zip(rows, after, strict=True)}
    got = fingerprint.compare(docs).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want and len(got) == len(rows)
    assert np.mean([r.near_edited for r in got]) > 0.5 > 0.2 > np.mean([r.near_next for r in got])
    got = fingerprint.compare(odd).collect()
    assert len(got) == len(ODD) and len({r.fingerprint for r in got if r.doc_id == 4}) == 1
    assert fingerprint.compare(empty(odd)).count() == 0
    one = fingerprint.compare(odd.where("doc_id = 7")).first()
    assert one.near_next == 1.0


def test_likeness_takes_the_whole_common_prefix(spark, docs):
    """Of compared rows the prefix is exact, not cut to a kept mark; of fingerprints alone it is cut to one."""
    rows = [(2, "abcdefghijklmnop" * 9 + "x" * 70), (1, "abcdefghijklmnop" * 9 + "y" * 70)]
    got = {r.doc_id: r for r in fingerprint.compare(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[2].near_next == got[1].near_next == 2 * 144 / 428
    a, b = (fingerprint.Prefixes(t) for _, t in rows)
    assert a.extension(0, b, 0) == 144 and a.extension(0, b, 16) == 128 == a.extension(16, b, 0) and a.extension(32, b, 32) == 112
    marks = [(x.split(".")[2], y.split(".")[2]) for x, y in [[fingerprint.fingerprint(t) for _, t in rows]]]
    assert fingerprint.kept_prefix(*marks[0]) == max(m for m in fingerprint.MARKS.tolist() if m <= 144)
    ordered = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    near = {r.doc_id: (r.near_edited, r.near_next) for r in fingerprint.compare(docs).collect()}
    for (i, t), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        for found, other in zip(near[i], (fingerprint.edited(t, after), after), strict=True):
            common = next((k for k, (x, y) in enumerate(zip(t, other, strict=False)) if x != y), min(len(t), len(other)))
            assert found >= min(0.999, 2 * common / max(1, len(t) + len(other)))


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert quality.score(odd, labels).count() == len(ODD) and quality.score(empty(odd), labels).count() == 0
    assert {r.score for r in quality.score(odd, labels.where("false")).collect()} == {0.5}
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]


def test_html(spark):
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>Title &amp; more</h1><p>First<br>para <b>bo</b>ld&nbsp;x<p>Tiny.<div class=ad>Buy</div><form>Mail</form><script>var t="</p>";</script><section id=comments>Nice!</section></article>
    <aside>side</aside><article class="comment">me too</article><footer>(c)</footer></body></html>"""
    assert htmltext.extract(page) == "Title & more\n\nFirst para bold x\n\nTiny."
    text = "A long paragraph of the page's text, which no element marks as its article, goes on and on. " * 2
    assert htmltext.extract(f"<ul><li><a>one</a><li><a>two</a></ul><div><p>{text}<p>End.</div><div class='sidebar'>x</div>") == f"{text.strip()}\n\nEnd."
    assert htmltext.extract(None) == htmltext.extract("") == htmltext.extract("<!-- open") == ""
    assert htmltext.extract("a < b") == "a < b"
    rows = spark.createDataFrame([(1, None, None), (None, "u", page), (1, None, "<p>" + "z " * 100_000)], "page_id bigint, url string, html string")
    assert sorted(r.n_chars for r in htmltext.main_text(rows).collect()) == [0, 38, 199_999]
    assert htmltext.main_text(empty(rows)).count() == 0


def test_html_article_beside_the_body():
    """Marks that hold a small part of the text don't drop the rest; marks that hold most of it do."""
    body = [f"Paragraph {k} of the body, which stands in an element without a name of its own, is fairly long." for k in range(4)]
    inner = "".join(f"<p>{x}</p>" for x in body)
    card = "<article><p>A teaser of another page.</p></article>"
    assert htmltext.extract(f"<div id=content>{inner}</div>{card}") == "\n\n".join([*body, "A teaser of another page."])
    assert htmltext.extract(f"<div id=content>{inner}</div><article><a>A teaser that is a link</a></article>") == "\n\n".join(body)
    assert htmltext.extract(f"<div><p>Site.</p></div><article><h1>Short</h1><p>One.<p>Two.<p>Three.{inner}</article><div><p>{body[0]}</p></div>") == "\n\n".join(["Short", "One.", "Two.", "Three.", *body])
    assert htmltext.extract("<main><p>Hi.</p></main><p>Me.</p>") == "Hi."
    assert htmltext.extract("<main><ul><li><a>one</a><li><a>two</a></ul></main><p>(c)</p>") == "one\n\ntwo"


def test_html_boilerplate_at_the_edges():
    """A title before a share bar and a short ending after adverts are part of the text; short lines far before it aren't."""
    long = ["A long paragraph of the page's text, which no element marks as its article, goes on and on. " * 3 + x for x in "ab"]
    share, advert = "<div class=share>Tweet</div><div class=share>Mail</div>", "<div class=advert>Buy</div><div class=advert>Now</div><div class=related>Next</div>"
    inner = f"<p>{long[0]}</p><p>{long[1]}</p>"
    whole = "\n\n".join(["A title", *long, "The short ending."])
    assert htmltext.extract(f"<h1>A title</h1>{share}{inner}{advert}<p>The short ending.</p>") == whole
    assert htmltext.extract(f"<h1>A title</h1><div><a>one</a></div><div><a>two</a></div>{inner}<div><a>three</a></div>{advert}<p>The short ending.</p>") == whole
    assert htmltext.extract(f"<p>Away.</p><h1>A title</h1><p>By me.</p>{share}{inner}{advert}<p>The short</p>{share}<p>ending.</p>") == "\n\n".join(["A title", "By me.", *long, "The short", "ending."])
