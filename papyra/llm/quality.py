"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics of the whole text (shares of letters, marks and digits, word and line lengths, repetition, entropy) are
standardised; random Fourier features approximate a Gaussian kernel over them. Each partition of the training rows
sums its part of the normal equations, and the sums give the ridge weights. A quarter of the training rows is kept out
of the fit; on it the ridge scores are calibrated by pool-adjacent-violators, so that a score is a probability of label 1.

Fitted on a bounded sample of labelled rows: at most ``MAX_ROWS``, chosen by a hash of the id. Prediction reads whole
texts of all rows. Null and empty texts have the statistics of the empty text and get a score like any other. With no
label to learn from, every score is 0.5; with one class only, it is that class. Repeated rows each get their score and teach
each by itself, an empty table gives no rows. Columns other than doc_id and text, whatever their names, are left out by
score() and stay in accept().
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import add_columns_by, fold, free_names, map_rows, written

#: Labelled rows that are fitted on, at most; random features; ridge; width of the kernel; seed of the features.
MAX_ROWS, FEATURES, RIDGE, WIDTH, SEED = 20_000, 256, 1e-2, 4.0, 7
#: Partitions that sum the normal equations: so many matrices reach the driver.
SUMS = 8
#: Scores from here on are label 1.
ACCEPTED = 0.7

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".,;:", b"!?", b"#$%&*", b"|<>{}[]()=+/\\~^_@", b"'\"`-"]
_OF = np.full(256, len(_CLASSES))
for _k, _c in enumerate(_CLASSES):
    _OF[list(_c)] = _k


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    n = len(raw)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(_OF, bytes_, minlength=len(_CLASSES) + 1) / max(1, n)
    p = bytes_[bytes_ > 0] / max(1, n)
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    count = Counter(words)
    upper = shares[1] / max(1e-9, shares[0] + shares[1]) if n else 0.0
    sentences = raw.split(b". ")
    return [
        *np.sqrt(shares).tolist(),
        upper,
        float(np.log1p(n)),
        float(-(p * np.log2(p)).sum()),
        float(np.log1p(sum(map(len, words)) / w)),
        len(count) / w,
        len(count) / w**0.7,
        max(count.values(), default=0) / w,
        sum(map(eq, words, words[1:])) / w,
        len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        len(set(sentences)) / len(sentences),
        float(np.log1p(w / len(sentences))),
    ]


class Model:
    """Standardisation, random features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, deviation
        self.directions = rng.normal(size=(len(mean), FEATURES)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(1 + FEATURES)
        self.steps = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phase)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing steps nearest to y, as points to interpolate between."""
    at, back, n = np.unique(x, return_inverse=True, return_counts=True)
    means = np.bincount(back, y) / n
    pools: list[list[float]] = []  # sum, weight, first x, last x
    for v, m, k in zip(at.tolist(), means.tolist(), n.tolist(), strict=True):
        pools.append([m * k, k, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, k, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + k, pools[-1][2], last]
    xs = [v for p in pools for v in (p[2:] if p[2] < p[3] else p[2:3])]
    ys = [p[0] / p[1] for p in pools for _ in (p[2:] if p[2] < p[3] else p[2:3])]
    return np.array(xs), np.array(ys)


def kept_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(1)), F.lit(4)) == 0


def fit(documents: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2, max_rows: int = MAX_ROWS) -> Model:
    """A model from rows of ``labels`` (doc_id, quality) outside the held fold. Several labels of one id count as their mean."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null").where(fold("doc_id", folds) != held)
    n = own.count()
    if n > max_rows:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 1.1 * max_rows / n))
    own = own.groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id")).limit(max_rows)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def stats() -> Callable[..., list[tuple]]:
        return lambda doc_id, quality, out, text: [(doc_id, quality, out, statistics(text))]

    # The sampled labels are at most max_rows rows of 17 bytes.
    rows = written(map_rows(docs.join(F.broadcast(own), "doc_id").select("doc_id", "quality", kept_out(), "text"), stats, "doc_id bigint, quality double, out boolean, stats array<double>"), "stats")
    width = len(statistics(""))
    sums = rows.select(F.count("*"), *(f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(width))).first()
    if not sums[0]:
        return Model(np.zeros(width), np.ones(width))
    model = Model(np.array(sums[1 : 1 + width]), np.maximum(1e-6, np.array(sums[1 + width :])))

    def normal() -> Callable[..., Iterable[tuple]]:
        size = 1 + FEATURES
        total, right = np.zeros((size, size)), np.zeros(size)

        class Sums:
            def __init__(self) -> None:
                self.x: list[list[float]] = []
                self.y: list[float] = []

            def add(self) -> None:
                nonlocal total, right
                z = model.features(np.array(self.x).reshape(-1, width))
                total, right = total + z.T @ z, right + z.T @ np.array(self.y)
                self.x, self.y = [], []

            def __call__(self, quality: float, x: list[float]) -> Iterable[tuple]:
                self.x.append(x)
                self.y.append(quality)
                if len(self.x) >= 1024:
                    self.add()
                return ()

            def finish(self) -> Iterable[tuple]:
                self.add()
                return [(total.ravel().tolist(), right.tolist())]

        return Sums()

    parts = map_rows(rows.where("not out").select("quality", "stats").repartition(SUMS), normal, "a array<double>, b array<double>", finish=True).collect()
    a = sum(np.array(p["a"]).reshape(1 + FEATURES, -1) for p in parts)
    b = sum(np.array(p["b"]) for p in parts)
    model.weights = np.linalg.solve(a + RIDGE * np.eye(1 + FEATURES), b)
    points = rows.where("out").select("quality", "stats").collect() or rows.select("quality", "stats").collect()  # at most max_rows
    model.steps = isotonic(model.raw(np.array([p["stats"] for p in points])), np.array([p["quality"] for p in points]))
    return model


def scored(documents: DataFrame, model: Model, column: str) -> DataFrame:
    """``documents`` with each text's score; the texts alone go through Python, a few hundred scored at once."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[tuple]], list[tuple]]:
        own = held.value
        return lambda rows: [(x,) for x in own.score(np.array([statistics(text) for (text,) in rows])).tolist()]

    return add_columns_by(documents, ["text"], make, f"{column} double")


def score(documents: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2, accepted: float = ACCEPTED) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``."""
    model = fit(documents, labels, folds=folds, held=held)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return scored(docs, model, "score").select("doc_id", "held_out", "score", (F.col("score") >= accepted).cast("int").alias("predicted"))


def accept(documents: DataFrame, labels: DataFrame, *, accepted: float = ACCEPTED) -> DataFrame:
    """``documents`` without the rows that score below ``accepted``; all columns stay, whatever their names."""
    (column,) = free_names(documents, "_score")
    return scored(documents, fit(documents, labels), column).where(F.col(column) >= accepted).drop(column)
