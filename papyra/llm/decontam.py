"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against the windows of every document.

A benchmark of up to ``MAX_BROADCAST_BYTES`` is broadcast with its words. Of a larger one a filter of fixed size is: a bit for
each hash of a window. Document windows that hit it, and no others, meet the benchmark's in a join on their words. Both
ways give the same rows.

A word is a maximal run of 0-9, a-z (A-Z are lower-cased first) and characters outside ASCII. An item gives a
window for each run of ``n`` consecutive words; an item of fewer words, but not none, is one window. Hash hits are
verified word by word, so a hash collision changes nothing.

Nulls and empty texts have no words, long texts are read whole, empty tables give no rows or no hits. A row without an item id marks words but is in no list of items; equal rows
of the benchmark count once. Repeated document rows each get their result. Further columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import WordHashes, add_columns, free_names, map_rows, mixed, rolled

#: Upper-case letters to lower case; every other ASCII byte that is no letter or digit to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_RUN = re.compile(rb"[^ ]+")
#: Benchmarks of more text than this are not broadcast but a filter of them is, of 2 ** FILTER_BITS bits (8 MB) at most.
MAX_BROADCAST_BYTES, FILTER_BITS = 4 << 20, 26
_BITS = 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class NgramSet:
    """The windows of benchmark items, found by hash and verified by their words."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], n: int) -> None:
        self.hashes = WordHashes()
        self.items = [(i, w) for i, w in ((i, words(t)) for i, t in items) if w]
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, w) in enumerate(self.items):
            size = min(n, len(w))
            for start, h in enumerate(rolled(self.hashes.array(w), size).tolist()):
                self.at[size][h].append((k, start))
        self.maybe = {}
        for size, found in self.at.items():
            self.maybe[size] = np.zeros(1 << _BITS, bool)
            self.maybe[size][np.fromiter(found, np.uint64, len(found)) >> np.uint64(64 - _BITS)] = True

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans inside windows, and the ids of the items that have these windows."""
        found, ids = [], set()
        if not w or not self.at:
            return [], ids
        hashes = self.hashes.array(w)
        for size, at in self.at.items():
            own = rolled(hashes, size)
            for start in np.flatnonzero(self.maybe[size][own >> np.uint64(64 - _BITS)]).tolist():
                same = [k for k, s in at.get(int(own[start]), ()) if self.items[k][1][s : s + size] == w[start : start + size]]
                if same:
                    found.append((start, start + size))
                    ids.update(self.items[k][0] for k in same if self.items[k][0] is not None)
        return merged(found), ids


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of these spans and what stands between them."""
    if not spans or text is None:
        return text
    raw = text.encode()
    places = [m.span() for m in _RUN.finditer(raw.translate(_TABLE))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def row(doc_id: int | None, text: str | None, n_words: int, spans: list[tuple[int, int]], ids: Iterable[str], cut: bool) -> tuple:
    ids = sorted(ids)
    n_hit = sum(b - a for a, b in spans)
    digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
    return (doc_id, n_words, n_hit, len(ids), digest, n_hit > 0, ids, [{"start": a, "stop": b} for a, b in spans], without(text, spans) if cut else None)


SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:bigint,stop:bigint>>, cleaned string"


def scan(documents: DataFrame, benchmark: DataFrame, *, n: int = 10, cut: bool = False, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """For every row of ``documents`` (doc_id, text) the words inside windows of ``benchmark`` (item_id, text).

    Spans count words from 0. With ``cut``, ``cleaned`` is the text without the spans. The broadcast is bounded:
    its bytes are summed first, and a benchmark beyond ``max_broadcast_bytes`` is joined on its windows.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if total > max_broadcast_bytes:
        return joined(docs, items, n, cut, total)
    held = docs.sparkSession.sparkContext.broadcast([tuple(x) for x in items.collect()])

    def make() -> Callable[..., list[tuple]]:
        known = NgramSet(held.value, n)

        def one(doc_id: int | None, text: str | None) -> list[tuple]:
            w = words(text)
            return [row(doc_id, text, len(w), *known.hits(w), cut)]

        return one

    return map_rows(docs, make, SCHEMA)


def row_key(documents: DataFrame) -> Column:
    """Rows with the same key have the same id and text, null ids included (a null text is as an empty one)."""
    text, doc_id = documents["text"].cast("string"), documents["doc_id"].cast("string")
    return F.concat(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), F.coalesce(doc_id, F.lit("-")))


class WindowFilter:
    """Which hashes of windows a benchmark may have: bits of 64-bit words, for all sizes of windows together."""

    def __init__(self, bits: int, words_: np.ndarray | None = None) -> None:
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), np.uint64) if words_ is None else words_

    def places(self, hashes: np.ndarray, size: int) -> np.ndarray:
        return mixed(hashes + np.uint64(size)) >> np.uint64(64 - self.bits)

    def add(self, hashes: np.ndarray, size: int) -> None:
        at = self.places(hashes, size)
        np.bitwise_or.at(self.words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))

    def hit(self, hashes: np.ndarray, size: int) -> list[int]:
        """Places in ``hashes`` that may be windows of the benchmark."""
        at = self.places(hashes, size)
        return np.flatnonzero(self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).tolist()

    @classmethod
    def of(cls, items: DataFrame, n: int, total: int) -> WindowFilter:
        """The filter of all windows of ``items``: each partition's words that have a bit, put together."""
        bits = min(FILTER_BITS, max(16, (4 * total).bit_length()))

        def make() -> Callable[..., Iterable[tuple]]:
            own, hashes = cls(bits), WordHashes()

            class Bits:
                def __call__(self, text: str | None) -> Iterable[tuple]:
                    w = words(text)
                    if w:
                        size = min(n, len(w))
                        own.add(rolled(hashes.array(w), size), size)
                    return ()

                def finish(self) -> Iterable[tuple]:
                    at = np.flatnonzero(own.words)
                    return zip(at.tolist(), own.words[at].view(np.int64).tolist(), strict=True)

            return Bits()

        found = map_rows(items.select("text"), make, "word bigint, bits bigint", finish=True).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
        whole = cls(bits)
        whole.words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return whole


def hits_by_key(keyed: DataFrame, items: DataFrame, n: int, total: int) -> DataFrame:
    """key, found (windows) and ids (items) for every key of ``keyed`` (key, text) whose text holds a window: those that pass the filter meet in a join, dealt out by their text."""

    def item_windows() -> Callable[..., Iterable[tuple]]:
        def one(item_id: str | None, text: str | None) -> Iterable[tuple]:
            w = words(text)
            size = min(n, len(w))
            for start in range(len(w) - size + 1 if w else 0):
                yield item_id, size, b" ".join(w[start : start + size]).decode()

        return one

    made = map_rows(items, item_windows, "item_id string, size bigint, gram string").groupBy("size", "gram").agg(F.collect_set("item_id").alias("ids"))
    sizes = [r[0] for r in made.select("size").distinct().collect()]  # at most n numbers
    held = keyed.sparkSession.sparkContext.broadcast(WindowFilter.of(items, n, total))

    def own_windows() -> Callable[..., Iterable[tuple]]:
        known, hashes = held.value, WordHashes()

        def one(key: str | None, text: str | None) -> Iterable[tuple]:
            w = words(text)
            own = hashes.array(w)
            for size in sizes:
                for start in known.hit(rolled(own, size), size):
                    yield key, start, size, b" ".join(w[start : start + size]).decode()

        return one

    own = map_rows(keyed.distinct(), own_windows, "key string, start bigint, size bigint, gram string")
    return own.join(made, ["size", "gram"]).groupBy("key").agg(F.collect_set(F.struct("start", "size")).alias("found"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))


def spans_of(found: list[dict] | None) -> list[tuple[int, int]]:
    return merged((x["start"], x["start"] + x["size"]) for x in found or ())


def joined(docs: DataFrame, items: DataFrame, n: int, cut: bool, total: int) -> DataFrame:
    """scan() for benchmarks of any size."""
    keyed = docs.withColumn("key", row_key(docs))
    hit = hits_by_key(keyed.select("key", "text"), items, n, total)

    def finish() -> Callable[..., list[tuple]]:
        return lambda doc_id, text, found, ids: [row(doc_id, text, len(words(text)), spans_of(found), ids or (), cut)]

    return map_rows(keyed.join(hit, "key", "left").select("doc_id", "text", "found", "ids"), finish, SCHEMA)


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, n: int = 10, remove: str = "documents", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``documents`` without the documents that hold a window, or (``remove="spans"``) without the words inside windows.

    All columns stay; with spans, n_chars follows the text if the table has that column. Every row is judged by its
    own text, whatever the size of the benchmark and whether its id is null or comes again.
    """
    hit, text = free_names(documents, "_hit", "_cleaned")
    held = scan_rows(documents, benchmark, n, remove == "spans", max_broadcast_bytes, hit, text)
    if remove == "documents":
        return held.where(~F.col(hit)).select(*documents.columns)
    out = held.withColumn("text", F.col(text))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)


def scan_rows(documents: DataFrame, benchmark: DataFrame, n: int, cut: bool, max_broadcast_bytes: int, hit: str, text: str) -> DataFrame:
    """``documents`` with the columns ``hit`` and ``text`` (cleaned) beside its own: in one pass, or joined as in scan()."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    added = f"{hit} boolean, {text} string"
    if total > max_broadcast_bytes:
        key, found_ = free_names(documents, "_key", "_found")
        keyed = documents.withColumn(key, row_key(documents))
        hits = hits_by_key(keyed.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")), items, n, total).select(F.col("key").alias(key), F.col("found").alias(found_))

        def judge() -> Callable[..., tuple]:
            def one(text: str | None, found: list[dict] | None) -> tuple:
                spans = spans_of(found)
                return bool(spans), without(text, spans) if cut else None

            return one

        return add_columns(keyed.join(hits, key, "left"), ["text", found_], judge, added)
    held = documents.sparkSession.sparkContext.broadcast([tuple(x) for x in items.collect()])

    def make() -> Callable[..., tuple]:
        known = NgramSet(held.value, n)

        def one(text: str | None) -> tuple:
            spans = known.hits(words(text))[0]
            return bool(spans), without(text, spans) if cut else None

        return one

    return add_columns(documents, ["text"], make, added)
