"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, at i, the sum of c_j * B^j over the first i code points modulo a prime; with it the
hash of any span is two look-ups and a product, so that spans of two texts compare in constant time and their longest
common extension is found by binary search. A fingerprint has the length and hash of the whole text, hashes of
prefixes at lengths that grow by a quarter, and the ``KEPT`` smallest hashes of spans of ``SPAN`` code points. Equal
texts have equal fingerprints.

The likeness of two fingerprints is 1 if they are equal; else the larger of two figures below 1: the share of spans in
common (Dice, estimated from the smallest hashes of both), and twice the common prefix by the sum of lengths. Where both
texts are there, as in compare(), the prefix is their longest common extension; of fingerprints alone it is as far as
the kept prefixes show it, up to a fifth too short.

Null texts count as empty; empty texts are equal to each other and have likeness 0 to others. Rows are followed by the
row with the next smaller doc_id; rows without an id come last; equal ids are in order of a hash of their text, then of their
text, so that an id which many rows have is dealt to many tasks (rows that are equal in id and text go to one). A table of one
row is followed by itself, an empty one gives no rows. Texts are handled whole, one after the other: a text's arrays take about
50 bytes a character while it and its neighbour are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from papyra.llm.common import mixed, packed, partitions, pieces

SPAN, KEPT = 16, 64
#: Two primes below 2^31 and the bases: hashes are pairs, 62 bits.
PRIMES, BASES = (2147483629, 2147483587), (1000003, 29996224)
_GROWTH = 1.25


def _marks() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * _GROWTH)))
    return out


MARKS = np.array(_marks(), np.int64)


class Powers:
    """Powers of the bases, and of their inverses, as far as they have been asked for; those for very long texts are let go."""

    KEPT = 1 << 20

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def need(self, n: int) -> None:
        while len(self.up[0]) <= n:
            for table, bases in ((self.up, BASES), (self.down, [pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True)])):
                for k, p in enumerate(PRIMES):
                    size = len(table[k])
                    table[k] = np.concatenate((table[k], table[k] * np.uint64(pow(bases[k], size, p)) % np.uint64(p)))


    def let_go(self) -> None:
        if len(self.up[0]) > self.KEPT:
            self.clear()


POWERS = Powers()


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        POWERS.need(self.n)
        self.sums = []
        for k, p in enumerate(PRIMES):
            terms = points * POWERS.up[k][: self.n] % np.uint64(p)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(p))))

    def spans(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans, the same for equal spans wherever they stand."""
        out = np.zeros(len(starts), np.uint64)
        for k, p in enumerate(PRIMES):
            part = (self.sums[k][stops] + np.uint64(p) - self.sums[k][starts]) * POWERS.down[k][starts] % np.uint64(p)
            out = out << np.uint64(31) | part
        return out

    def span(self, start: int, stop: int) -> int:
        return int(self.spans(np.array([start]), np.array([stop]))[0])

    def same(self, at: int, other: Prefixes, at_other: int, size: int) -> bool:
        """Whether spans of this size have equal hashes; powers shift the earlier one, so that nothing is inverted."""
        for k, p in enumerate(PRIMES):
            x = int(self.sums[k][at + size]) - int(self.sums[k][at])
            y = int(other.sums[k][at_other + size]) - int(other.sums[k][at_other])
            shift = int(POWERS.up[k][abs(at - at_other)])
            if ((x * shift - y) if at < at_other else (x - y * shift)) % p:
                return False
        return True

    def extension(self, at: int, other: Prefixes, at_other: int) -> int:
        """Length of the longest common span that begins at these places."""
        low, high = 0, min(self.n - at, other.n - at_other)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(at, other, at_other, mid):
                low = mid
            else:
                high = mid - 1
        return low


def fingerprint(text: str | Prefixes) -> str:
    """Length, whole hash, prefix hashes (16 bits each) and smallest span hashes (32 bits each), in hex."""
    own = Prefixes(text) if isinstance(text, str) else text
    whole = own.span(0, own.n)
    marks = MARKS[: int(np.searchsorted(MARKS, own.n, "right"))]
    heads = mixed(own.spans(np.zeros(len(marks), np.int64), marks)) >> np.uint64(48)
    starts = np.arange(max(0, own.n - SPAN + 1))
    found = mixed(own.spans(starts, starts + SPAN))
    least = found
    size = KEPT
    while True:  # the smallest distinct ones; more are taken while repeats leave too few
        least = np.unique(np.partition(found, size)[:size] if size < len(found) else found)
        if len(least) >= KEPT or size >= len(found):
            break
        size *= 4
    least = least[:KEPT] >> np.uint64(32)
    return f"{own.n:x}.{whole:016x}.{''.join(f'{x:04x}' for x in heads.tolist())}.{''.join(f'{x:08x}' for x in least.tolist())}"


def kept_prefix(a: str, b: str) -> int:
    """The largest mark up to which the prefix hashes of two fingerprints are equal, by binary search."""
    low, high = 0, min(len(a), len(b)) // 4
    while low < high:
        mid = (low + high + 1) // 2
        if a[: 4 * mid] == b[: 4 * mid]:  # all of them: 16 bits alone may agree by chance
            low = mid
        else:
            high = mid - 1
    return int(MARKS[low - 1]) if low else 0


def likeness(a: str, b: str, common: int | None = None) -> float:
    """How near two fingerprints are; ``common`` is the common prefix, if the texts were there to find it."""
    if a == b:
        return 1.0
    (na, _, pa_, sa), (nb, _, pb, sb) = a.split("."), b.split(".")
    n, m = int(na, 16), int(nb, 16)
    if common is None:
        common = kept_prefix(pa_, pb)
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (sa, sb))
    both = 0.0
    if x and y:
        least = set(sorted(x | y)[:KEPT])
        j = len(least & x & y) / len(least)
        both = 2 * j / (1 + j)
    return min(0.999, max(both, 2 * common / (n + m) if n + m else 0.0))


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: The least hash of a text.
_FIRST = -(1 << 63)


def _before(cut: tuple[int | None, int]) -> Column:
    """Whether a row (doc_id, mark) comes before a bound, by descending id with nulls last, then by mark. Bounds of whole ids don't look at marks."""
    doc_id, mark = cut
    least = F.col("mark") < mark if mark > _FIRST else F.lit(False)
    if doc_id is None:
        return F.col("doc_id").isNotNull() | least
    return F.coalesce((F.col("doc_id") > doc_id) | ((F.col("doc_id") == doc_id) & least), F.lit(False))


def bounds(docs: DataFrame, n: int) -> list[tuple[int | None, int]]:
    """Ordered bounds of about ``n`` ranges: quantiles of the ids, and for ids that have more than a range's share of the rows even steps of the hash."""
    total = docs.count()
    if not total:
        return []
    quantiles = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    hot = docs.groupBy("doc_id").count().where(F.col("count") * n > total).collect()  # fewer than n rows
    cuts = {(i, _FIRST) for i in quantiles} | {(r["doc_id"], _FIRST) for r in hot}
    for doc_id, count in hot:
        parts = -(-count * n // total)
        cuts |= {(doc_id, _FIRST + k * (1 << 64) // parts) for k in range(1, parts)}
    return sorted(cuts, key=lambda c: (c[0] is None, -(c[0] or 0), c[1]))


def _range_of(cuts: list[tuple[int | None, int]], low: int, high: int) -> Column:
    """The number of a row's range among ordered bounds, by a tree of tests as deep as the logarithm of their number."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(_before(cuts[mid]), _range_of(cuts, low, mid)).otherwise(_range_of(cuts, mid + 1, high))


def compare(documents: DataFrame) -> DataFrame:
    """The fingerprint of every row of ``documents`` (doc_id, text), of its edited text, and how near the next row's is.

    The edited text has its last third (rounded down) replaced by the beginning of the next row's text, by descending
    doc_id; the last row is followed by the first. Rows go to ranges of (doc_id, hash of the text), whose bounds come from the ids;
    the first row of each range goes to the range before as well, so that each range knows what follows it.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    n = max(2, partitions(spark))
    cuts = bounds(docs, n)
    placed = docs.withColumn("bucket", _range_of(cuts, 0, len(cuts)))
    firsts = placed.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect()  # a row a range: its first id, null if it has no other
    order = sorted(firsts, key=lambda r: r["bucket"])
    guests = [(r["bucket"], r["doc_id"], order[k - 1]["bucket"]) for k, r in enumerate(order)]  # the first range's goes to the last
    at = spark.createDataFrame(guests, "bucket int, doc_id bigint, host int")
    same = (F.col("p.bucket") == F.col("g.bucket")) & F.col("p.doc_id").eqNullSafe(F.col("g.doc_id"))
    guest = (
        placed.alias("p").join(F.broadcast(at.alias("g")), same).groupBy(F.col("g.host").alias("bucket"), F.col("p.doc_id").alias("doc_id"))
        .agg(F.min(F.struct("p.mark", "p.text")).alias("r")).select("bucket", "doc_id", "r.mark", "r.text", F.lit(1).alias("guest"))
    )
    columns = ["bucket", "guest", "doc_id", "mark", "text"]
    every = placed.withColumn("guest", F.lit(0)).select(*columns).unionByName(guest.select(*columns))
    # The order within a range: own rows by descending id, then the guest.
    dealt = every.repartitionByRange(n, "bucket").sortWithinPartitions(F.col("bucket"), F.col("guest"), F.col("doc_id").desc_nulls_last(), "mark", "text").select("bucket", "guest", "doc_id", "text")
    kind = T._parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            held = None  # range, doc_id, text, its prefix arrays and fingerprint
            for batch in batches:
                for part in pieces(tuple(batch.columns), 128) if batch.num_rows else ():
                    for b, g, doc_id, text in zip(*(c.to_pylist() for c in part), strict=True):
                        sums = Prefixes(text)
                        own = fingerprint(sums)
                        if held is not None and held[0] == b:
                            yield follow(held[1], held[2], held[3], held[4], text, sums, own)
                        held = None if g else (b, doc_id, text, sums, own)
                        POWERS.let_go()

        rows: list[tuple] = []
        for row in pairs():
            rows.append(row)
            if len(rows) >= 1024:
                yield from packed(rows, arrow)
                rows = []
        yield from packed(rows, arrow)

    return dealt.mapInArrow(run, kind)


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


def follow(doc_id: int | None, text: str, sums: Prefixes, mark: str, following: str, next_sums: Prefixes, next_mark: str) -> tuple:
    changed = edited(text, following)
    changed_sums = Prefixes(changed)
    own = fingerprint(changed_sums)
    near = [likeness(mark, x, sums.extension(0, other, 0)) for x, other in ((own, changed_sums), (next_mark, next_sums))]
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, own, *near
