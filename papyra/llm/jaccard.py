"""N-gram Jaccard join by the prefix filters of several global token orders.

A document's tokens are the distinct shingles of five words (runs of characters other than white space, A-Z in lower
case) as 64-bit hashes; with fewer words the whole sequence is the one token. Documents with equal token sets are one
class, named by a 64-bit hash of the set (sets whose names collide, which a second hash tells, get the second as their
name): all further work is on classes, so copies cost nothing. Two classes link when their Jaccard similarity is at
least ``percent`` / 100.

If x and y link they have at least m = ceil(percent (|x| + |y|) / (100 + percent)) tokens in common, so that in any global
order the first |x| - m + 1 tokens of x and the first |y| - m + 1 of y share one. Three orders are used:

1. Frequent tokens last (a bounded list, counted over all documents), otherwise random. It gives each class the longest
   prefix that any partner asks for. Linked classes have t = m + 1 - ceil(percent max(|x|, |y|) / 100) tokens or more of
   these prefixes in common, so the prefix tokens that two classes or more hold, S(x), carry the filters of the others:
   the first |S(x)| - t + 1 of x and the first |S(y)| - t + 1 of y share one.
2. Rarest first, by the exact number of classes that have the token in their prefix. A passage that many documents
   hold comes last here.
3. Random, with another seed.

One join makes pairs under the second order, or under the first where t is too small to shorten S; its rows also compare
parity bitmaps of whole sets, which differ in at most as many bits as the sets do in tokens. A pair then has to pass the
filters of all three orders, and to have t tokens of S in common, before any whole set is fetched for the exact test. No
filter loses a pair that links.

A group of near copies isn't expanded into pairs: in a few rounds each class is verified against one class of those it
meets, and components are built; then only candidates in different components are left to compare, all of them.

Null and empty texts have no tokens and link with nothing. Rows without a doc_id get their size, no component, and
connect nothing. Repeated rows get the same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from papyra.llm.common import SLICE, WordHashes, discard, map_rows, mixed, rolled, tidy, written

WORDS, PERCENT = 5, 80
#: Seeds of the random orders, the first and the third.
SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
#: Common prefix tokens from which on the second order makes the pairs.
RAREST_FROM = 4
#: Most tokens in the list of frequent ones; a token gets there if it is in one of so many documents of a block.
FREQUENT, ONE_IN = 100_000, 1024
#: Classes whose documents are found by a broadcast of their ids, 16 bytes each; more are found by a shuffled join.
MAX_BROADCAST_ROWS = 2_000_000
#: Tokens that are counted together for the list of frequent ones.
BLOCK = 1_000_000
#: Rounds of first links; parts that a frequent token's classes are dealt to; classes that a task remembers.
STARS, PARTS, REMEMBERED = 2, 64, 200_000
#: Bits of a class's parity bitmap, as columns of 64.
BITS = 256
_BITS = [f"bits{i}" for i in range(BITS // 64)]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOP = np.uint64(1 << 63)


class Shingler:
    def __init__(self, size: int = WORDS) -> None:
        self.size, self.hashes = size, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct tokens, ascending."""
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        own = self.hashes.array(words)
        return np.unique(rolled(own, self.size)) if len(own) >= self.size else rolled(own, len(own)) ^ np.uint64(len(own))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def name(tokens: np.ndarray, collided: frozenset[int] = frozenset()) -> int:
    """The class of a token set, as a signed 64-bit integer: its hash, or the second hash if the first is another set's too."""
    h = signed(xxhash.xxh3_64_intdigest(tokens.tobytes()))
    return second(tokens) if h in collided else h


def second(tokens: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=1))


def parity(tokens: np.ndarray) -> list[int]:
    """Whether an odd number of the tokens falls on each of BITS places, as signed 64-bit integers."""
    places = mixed(tokens ^ np.uint64(SEEDS[0])) % np.uint64(BITS)
    odd = np.bincount(places.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def prefix(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first tokens in the first order, ascending in it: as many as some partner might need."""
    n = len(tokens)
    size = n - -(-percent * n // 100) + 1
    key = mixed(tokens ^ np.uint64(SEEDS[0])) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        key = np.where(frequent[at] == tokens, key | _TOP, key)
    chosen = np.argpartition(key, size - 1)[:size] if size < n else np.arange(n)
    return tokens[chosen[np.argsort(key[chosen])]]


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """In one pass: a row for each document (doc_id, mark of its text, n, class, second hash, bitmap), and rows (token, documents) of tokens frequent in a block."""

    def make():  # type: ignore[no-untyped-def]
        shingle, counts = Shingler(size), Counter()
        state = {"docs": 0, "size": 0, "block": []}

        def close() -> None:
            if state["block"]:
                found, n = np.unique(np.concatenate(state["block"]), return_counts=True)
                often = n >= max(3, state["docs"] / ONE_IN)
                counts.update(dict(zip(found[often].tolist(), n[often].tolist(), strict=True)))
                state["docs"], state["size"], state["block"] = 0, 0, []

        class Rows:
            def __call__(self, doc_id: int | None, mark: int, text: str | None) -> list[tuple]:
                tokens = shingle(text)
                state["docs"] += 1
                if len(tokens):
                    state["block"].append(tokens)
                    state["size"] += len(tokens)
                if state["size"] >= BLOCK:
                    close()
                own = (name(tokens), second(tokens)) if len(tokens) else (None, None)
                return [(doc_id, mark, len(tokens), *own, None, None, *parity(tokens))]

            def finish(self) -> Iterable[tuple]:
                close()
                return ((None, None, None, None, None, signed(t), n, *[None] * len(_BITS)) for t, n in counts.most_common(FREQUENT))

        return Rows()

    marked = docs.select("doc_id", mark_of(F.col("text")), "text")
    return map_rows(marked, make, "doc_id bigint, mark bigint, n bigint, class bigint, other bigint, token bigint, often bigint, " + ", ".join(f"{x} bigint" for x in _BITS), finish=True)


def mark_of(text: Column) -> Column:
    """A hash that tells apart the texts of one id; a null text has the mark of no other."""
    return F.when(text.isNull(), F.lit(-(1 << 63))).otherwise(F.xxhash64(text))


def postings(docs: DataFrame, frequent, collided: frozenset[int], size: int, percent: int) -> DataFrame:  # type: ignore[no-untyped-def]
    """(token, class, n, at, often) for each prefix token of each document and its place in the first order; a task gives a class once."""
    kind = T._parse_datatype_string("token bigint, class bigint, n int, at int, often boolean")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, done = Shingler(size), frequent.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                found, classes, sizes = [], [], []
                for text in batch.column(0).slice(at, SLICE).to_pylist():
                    tokens = shingle(text)
                    if len(tokens) and (own := name(tokens, collided)) not in done:
                        if len(done) >= REMEMBERED:
                            done.clear()
                        done.add(own)
                        found.append(prefix(tokens, last, percent))
                        classes.append(own)
                        sizes.append(len(tokens))
                if found:
                    every, times = np.concatenate(found), [len(x) for x in found]
                    often = np.zeros(len(every), bool)
                    if len(last):
                        often = last[np.minimum(np.searchsorted(last, every), len(last) - 1)] == every
                    yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), times)), pa.array(np.repeat(np.array(sizes, np.int32), times)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in times])), pa.array(often)], schema=arrow)
        shingle = done = batch = found = None
        tidy()

    return docs.select("text").mapInArrow(run, kind)


def components(links: DataFrame) -> DataFrame:
    """(class, component) of all classes in ``links`` (a, b): large-star and small-star steps until nothing changes."""
    edges = written(links.selectExpr("greatest(a, b) a", "least(a, b) b").where("a != b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").selectExpr("b a", "m b").where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("case when b = m then a else b end a", "m b").where("a != b").distinct()
        before, edges = edges, written(small, "edges")
        if edges.count() == before.count() and edges.join(before, ["a", "b"], "left_anti").isEmpty():  # both are distinct
            break
    roots = edges.select(F.col("b").alias("class")).distinct()
    return edges.selectExpr("a class", "b component").unionByName(roots.withColumn("component", F.col("class")))


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, collided: frozenset[int], size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    sets = written(token_sets(docs, rows, pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), collided, size), "sets")
    x = pairs.join(sets.selectExpr("class a", "tokens x"), "a")
    both = x.join(sets.selectExpr("class b", "tokens y"), "b").select("a", "b", "x", "y")

    def make():  # type: ignore[no-untyped-def]
        def one(a: int, b: int, x: bytes, y: bytes) -> list[tuple]:
            return [(a, b)] if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) else []

        return one

    found = written(map_rows(both, make, "a bigint, b bigint"), "links")
    discard(sets)
    return found


def link(documents: DataFrame, *, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row of ``documents`` (doc_id, text)."""
    return grouped(documents, size=size, percent=percent).select("doc_id", "n_shingles", "component_id")


def grouped(documents: DataFrame, *, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """link() with the mark of each row's text, its class and component (a class of it); both are the empty set's for rows without tokens.

    Where ids come again with other texts, components may share their smallest doc_id, but not their name.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = written(signatures(docs, size, percent), "signatures")
    rows = seen.where("n is not null").select("doc_id", "mark", "n", "class", "other", *_BITS)
    # Names that two sets share: none is expected below 10^9 classes, a few at 10^10.
    twice = rows.where("class is not null").groupBy("class").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo != hi")
    collided = frozenset(r[0] for r in twice.select("class").collect())
    if collided:
        rows = rows.withColumn("class", F.when(F.col("class").isin(*collided), F.col("other")).otherwise(F.col("class")))
    rows = rows.drop("other")
    often = seen.where("token is not null").groupBy("token").agg(F.sum("often").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").collect()  # 8 bytes each
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64)))

    # Tokens that two classes or more have in their prefixes. Those of a rare token meet in one group. Frequent tokens, of
    # which there are at most FREQUENT, are dealt by class as well, so that no group holds a share of all documents.
    found = postings(docs, frequent, collided, size, percent).select("token", "class", "n", "at", F.when(F.col("often"), F.pmod("class", F.lit(PARTS))).otherwise(F.lit(-1)).alias("part"))
    group = Window.partitionBy("token", "part").orderBy("class")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = found.withColumn("new", F.coalesce(F.lag("class").over(group) != F.col("class"), F.lit(True)))
    # Tokens with the same classes (those of one passage, say) have the same mark, from which on they are one.
    marks = [F.expr(f"bit_xor(case when new then xxhash64(class, {i}) end)") for i in range(2)]
    often = F.col("part") >= 0
    met = first.withColumns({"df": F.sum(F.col("new").cast("int")).over(whole), "mark": F.xxhash64(*(c.over(whole) for c in marks))}).where(F.col("new") & (often | (F.col("df") > 1))).select("token", "class", "n", "at", often.alias("often"), "df", "mark")
    met = written(met, "shared")
    several = met.where("often").withColumn("new", F.lit(True)).groupBy("token").agg(F.count("*").alias("df"), F.xxhash64(*marks).alias("mark")).where("df > 1")  # at most FREQUENT rows
    met = met.where("not often").drop("often").unionByName(met.where("often").drop("often", "df", "mark").join(F.broadcast(several), "token"))
    # S of each class: its size k, and the places of its tokens in the second and the third order; then a row for each
    # mark, with the number of its tokens and the least of their places.
    own = Window.partitionBy("class")
    ranked = met.withColumns({
        "k": F.count("*").over(own).cast("int"),
        "at2": F.row_number().over(own.orderBy("df", F.xxhash64("token"), "token")) - 1,
        "at3": F.row_number().over(own.orderBy(F.xxhash64("token", F.lit(SEEDS[1])), "token")) - 1,
    })
    placed = ranked.groupBy("class", F.col("mark").alias("token")).agg(F.count("*").cast("int").alias("w"), F.first("n").alias("n"), F.first("k").alias("k"), *(F.min(x).alias(x) for x in ("at", "at2", "at3")))
    placed = written(placed.withColumn("component", F.col("class")), "placed")

    def least(n: str, m: str) -> str:
        """Tokens that linked sets of n and m tokens have in common at least."""
        return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"

    def needed(n: str, m: str) -> str:
        """Tokens of S that linked sets of n and m tokens have in common at least."""
        return f"({least(n, m)} + 1 - ({percent} * greatest({n}, {m}) + 99) div 100)"

    def near(n: str, m: str, i: str, j: str) -> str:
        """Whether a token at places i and j of the first order is among those one of which linked sets share."""
        return f"({i} <= {n} - {least(n, m)} and {j} <= {m} - {least(n, m)})"

    fits = lambda n, m: F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")

    def passing(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b; sizes n, m of the sets and k, l of S) that share enough tokens, and under every order one of both prefixes."""
        t = needed("n", "m")
        lists = placed.groupBy("class").agg(F.collect_list(F.struct("token", "w", "at", "at2", "at3")).alias("s"), F.collect_list("token").alias("tokens"))  # a document's prefix at most
        both = pairs.join(lists.selectExpr("class a", "s x"), "a").join(lists.selectExpr("class b", "s y", "tokens"), "b")

        def shares(place: str, x: str, y: str) -> Column:
            part = lambda side, most: f"transform(filter({side}, e -> e.{place} <= {most}), e -> e.token)"
            return F.expr(f"arrays_overlap({part('x', x)}, {part('y', y)})")

        enough = F.expr(f"aggregate(filter(x, e -> array_contains(tokens, e.token)), 0, (sum, e) -> sum + e.w) >= {t}")
        orders = shares("at", f"n - {least('n', 'm')}", f"m - {least('n', 'm')}") & shares("at2", f"k - {t}", f"l - {t}") & shares("at3", f"k - {t}", f"l - {t}")
        return both.where(enough & orders).select("a", "b")

    links = spark.createDataFrame([], "a bigint, b bigint")
    label = spark.createDataFrame([], "class bigint, component bigint")
    for star in range(STARS):
        # Each class against the class of another component that stands first in most of its tokens. How much of its
        # prefix a class shares comes first: the text that others were copied from shares most.
        rank = F.struct(F.expr("1000 * k div n") if star == 0 else F.xxhash64("class", F.lit(star)), "class", "n", "k", "component")
        firsts = placed.groupBy("token").agg(F.max(rank).alias("f")).select("token", F.col("f.class").alias("b"), F.col("f.n").alias("m"), F.col("f.k").alias("l"), F.col("f.component").alias("other"))
        close = placed.join(firsts, "token").where("component != other").where(fits("n", "m")).groupBy("class", "b").agg(F.sum("w").alias("times"), *(F.first(c).alias(c) for c in ("n", "m", "k", "l")))
        best = close.groupBy("class").agg(F.max_by(F.struct("b", "n", "m", "k", "l"), F.struct("times", "b")).alias("f")).select(F.col("class").alias("a"), "f.*")
        new = verified(docs, rows, written(passing(best), "pairs"), collided, size, percent)
        if new.isEmpty():
            continue
        links = links.unionByName(new)
        label = components(links)
        now = placed.drop("component").join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
        now = written(now, "placed")
        apart = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token")
        placed = written(now.join(apart, "token", "left_semi"), "apart")

    # What these links leave apart: all candidates in different components. A mark's least places only widen the filters.
    maps = rows.where("class is not null").groupBy("class").agg(*(F.first(x).alias(x) for x in _BITS))
    mapped = placed.drop("at3").join(maps, "class")
    a, b = mapped.alias("a"), mapped.alias("b")
    t = needed("a.n", "b.n")
    by_order = F.expr(f"case when {t} >= {RAREST_FROM} then a.at2 <= a.k - {t} and b.at2 <= b.k - {t} else {near('a.n', 'b.n', 'a.at', 'b.at')} end")
    alike = F.expr(" + ".join(f"bit_count(a.{x} ^ b.{x})" for x in _BITS) + f" <= a.n + b.n - 2 * {least('a.n', 'b.n')}")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.class") < F.col("b.class")) & (F.col("a.component") != F.col("b.component")) & fits("a.n", "b.n") & by_order & alike)
    pairs = written(pairs.select(F.col("a.class").alias("a"), F.col("b.class").alias("b"), F.col("a.n").alias("n"), F.col("b.n").alias("m"), F.col("a.k").alias("k"), F.col("b.k").alias("l")).distinct(), "pairs")
    rest = passing(pairs)
    more = verified(docs, rows, written(rest, "pairs"), collided, size, percent)
    if not more.isEmpty():
        label = components(links.unionByName(more))

    classes = rows.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    named = classes.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    answer = named.join(lowest, "component").select("class", "component", "component_id")
    out = rows.join(answer, "class", "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    none = F.lit(name(np.empty(0, np.uint64)))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), own_id.alias("component_id"), F.coalesce("class", none).alias("class"), F.coalesce("component", "class", none).alias("component"))


def token_sets(docs: DataFrame, rows: DataFrame, classes: DataFrame, collided: frozenset[int], size: int) -> DataFrame:
    """(class, tokens) of these classes, from one document of each (a repeated id gives its row again); tokens are little-endian, ascending."""
    one = written(rows.where("doc_id is not null").join(classes, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "chosen")
    if one.count() <= MAX_BROADCAST_ROWS:
        one = F.broadcast(one)

    def make():  # type: ignore[no-untyped-def]
        shingle = Shingler(size)

        def make_row(cls: int, text: str) -> list[tuple]:
            tokens = shingle(text)
            return [(cls, tokens.tobytes())] if len(tokens) and name(tokens, collided) == cls else []  # else a repeated id with another text

        return make_row

    return map_rows(docs.join(one, "doc_id").select("class", "text"), make, "class bigint, tokens binary")
