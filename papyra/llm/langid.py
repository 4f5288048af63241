"""Language identification by n-gram filters that answer with a bitmask of languages.

For each language the n-grams of characters (lengths ``ORDERS``, words in lower case with a blank on both sides) that
most of its labelled documents hold are put into a Bloom filter. All languages' filters share their hash functions
and are stored bit-sliced: slot i has one bit for each language, so that one AND of a few slots gives the set of all
languages that contain an n-gram. A text's score in a language is how many of its n-grams have the language's bit,
less what false positives are expected to add; the highest decides, and ties go to the language with more documents.

A slot has 64 bits; more languages take further slices. The grams are learned from a bounded sample of labelled rows: about
``MAX_ROWS`` of each language, chosen by a hash of id and text, in which repeated rows count once. Prediction reads whole
texts, and repeated rows each get theirs. Texts without a letter, and nulls, are ``und`` with score 0; so is
everything if there is nothing to learn from. Rows without a language teach nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import fold, map_rows, mixed

ORDERS = (2, 3, 4)
#: Labelled rows of a language that are learned from, about; n-grams of each order and language that are kept.
MAX_ROWS, KEPT = 4000, 1500
#: Languages that fit into a slot.
WIDTH = 64
PROBES = 3
#: Letters of a text that are looked up together.
BLOCK = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")


def plain(text: str | None) -> str:
    """The text's words in lower case with a blank around each; empty if it has no letter."""
    words = _WORD.findall((text or "").lower())
    return " " + " ".join(words) + " " if any(c.isalpha() for w in words for c in w) else ""


def grams(letters: np.ndarray, order: int) -> np.ndarray:
    """Hashes of all n-grams of a length: the code points, 21 bits each, mixed with the length."""
    m = len(letters) - order + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = letters[:m].copy()
    for j in range(1, order):
        out = out * np.uint64(0x100000001B3) + letters[j : j + m]
    return mixed(out + np.uint64(order << 56))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class SlicedBloom:
    """Bloom filters of any number of languages, 64 in a slice, that are read together."""

    def __init__(self, languages: list[str], members: list[list[int]]) -> None:
        self.languages = languages
        most = max([1, *map(len, members)])
        self.bits = max(10, int(np.ceil(np.log2(most * 12))))
        self.slices = [np.zeros(1 << self.bits, np.uint64) for _ in range(0, max(1, len(languages)), WIDTH)]
        for k, found in enumerate(members):
            for at in self.places(np.array(found, np.uint64)):
                self.slices[k // WIDTH][at] |= np.uint64(1 << k % WIDTH)
        one = np.uint64(1)
        self.false = np.array([float(((self.slices[k // WIDTH] >> np.uint64(k % WIDTH)) & one).mean()) ** PROBES for k in range(len(languages))])

    def places(self, hashes: np.ndarray) -> Iterable[np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        for j in range(PROBES):
            yield ((hashes >> np.uint64(j * 20)) & mask).astype(np.int64)

    def masks(self, hashes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """For each n-gram the languages of a slice that have it, as bits."""
        out = None
        for at in self.places(hashes):
            found = slots[at]
            out = found if out is None else out & found
        return out  # type: ignore[return-value]

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """N-grams with the bit of each language, and n-grams in all."""
        k, n = len(self.languages), 0
        out = np.zeros(k, np.int64)
        letters = code_points(text)
        for at in range(0, max(1, len(letters)), BLOCK):
            for order in ORDERS:
                own = grams(letters[at : at + BLOCK + order - 1], order)
                n += len(own)
                for first, slots in zip(range(0, k, WIDTH), self.slices, strict=False):
                    masks = self.masks(own, slots)
                    for low in range(0, min(WIDTH, k - first), 12):  # a slice of bits: how often each set of languages, then each language
                        width = min(12, k - first - low)
                        sets = np.bincount(((masks >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64), minlength=1 << width)
                        for j in range(width):
                            out[first + low + j] += sets.reshape(-1, 2, 1 << j)[:, 1].sum()
        return out, n

    def predict(self, text: str | None) -> tuple[str, float]:
        text = plain(text)
        if not text or not self.languages:
            return "und", 0.0
        counts, n = self.counts(text)
        fair = np.maximum(0, (counts - n * self.false) / np.maximum(1e-9, 1 - self.false))
        best = int(np.argmax(fair))
        total = float(fair.sum())
        return self.languages[best], float(fair[best]) / total if total else 1.0 / len(fair)


def learn(rows: DataFrame, *, max_rows: int = MAX_ROWS, kept: int = KEPT) -> SlicedBloom:
    """Filters from labelled rows (text, lang)."""
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}  # a row a language
    if not n:
        return SlicedBloom([], [])
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, max_rows / v))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang").distinct()

    def make() -> Callable[..., Iterable[tuple]]:
        seen: dict[str, Counter] = {}

        class Sums:
            def __call__(self, text: str, lang: str) -> Iterable[tuple]:
                letters = code_points(plain(text))
                own = seen.setdefault(lang, Counter())
                for order in ORDERS:
                    own.update((order, h) for h in np.unique(grams(letters, order)).tolist())
                return ()

            def finish(self) -> Iterable[tuple]:
                return ((lang, order, h - (1 << 64) if h >> 63 else h, c) for lang, own in seen.items() for (order, h), c in own.items())

        return Sums()

    found = map_rows(chosen, make, "lang string, size int, gram bigint, n bigint", finish=True).groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    top = found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= kept).select("lang", "gram").collect()  # at most 3 * kept rows a language
    members: dict[str, list[int]] = {k: [] for k in n}
    for r in top:
        members[r["lang"]].append(r["gram"] % (1 << 64))
    return SlicedBloom(list(n), list(members.values()))


def identify(documents: DataFrame, *, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; rows whose crc32(doc_id) mod ``folds`` is ``held`` teach nothing."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("held_out", F.coalesce(fold("doc_id", folds) == held, F.lit(False)))
    known = docs.sparkSession.sparkContext.broadcast(learn(docs.where("doc_id is not null and not held_out")))

    def make() -> Callable[..., list[tuple]]:
        filters = known.value
        return lambda doc_id, held_out, text: [(doc_id, held_out, *filters.predict(text))]

    return map_rows(docs.select("doc_id", "held_out", "text"), make, "doc_id bigint, held_out boolean, lang_pred string, score double")
