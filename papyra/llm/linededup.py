"""Line dedup with levelled sorted runs of line hashes. DataFrame operations only.

A line's key is the line without white space at both ends, A-Z in lower case. Keys of at least ``min_chars`` code
points that at least ``min_docs`` documents hold lose their lines, except in the largest doc_id that holds the key.

Runs are tables (key hash, documents, largest doc_id), bucketed and sorted by hash; no two runs have a key in common. Each
new batch of documents is counted, and a merge anti-join with every run parts its keys: those in no run become a run of level
0, those in one become a delta, which adds to the counts of that run's key. ``fan`` runs of a level are compacted into one
of the next, deltas into one as soon as there are ``fan``. A key's documents are its run's row and its delta, so what
is dropped hangs on the anti-join: a known key taken for a new one would be counted in two pieces. Buckets are
the same in all runs, so runs meet in joins without an exchange. Documents are dealt to batches by a hash of the id, so that
every document's keys are counted in one batch and counts add up. Hashes are 128 bits (two 64-bit hashes); no text is
kept in a run.

A null or empty text is one empty line and gives the empty text. Rows without a doc_id hold no keys and stay as they
are. Repeated rows of an id count as one document, and each gets its result. An empty table gives an empty one. Long texts are
split whole. The names of the columns that dedup() adds are its caller's to choose.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import free_names, partitions, scratch_dir, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches that a whole corpus is dealt to, and runs of a level that are compacted.
BATCHES, FAN = 5, 3
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "h1 bigint, h2 bigint, n bigint, last bigint"


def key(line: Column) -> Column:
    """The line's key; lower() is the same as A-Z for texts in ASCII, and cheaper than translate()."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def keyed_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, mark (a hash of the text), place and key hashes of every line whose key is long enough."""
    parts = F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.struct(i.cast("int").alias("i"), key(x).alias("k")))
    long = F.filter(parts, lambda x: F.char_length(x["k"]) >= min_chars)
    return (
        documents.where("doc_id is not null and text is not null")
        .select("doc_id", F.xxhash64("text").alias("mark"), F.explode(long).alias("x"))
        .select("doc_id", "mark", F.col("x.i").alias("place"), F.xxhash64("x.k").alias("h1"), F.xxhash64(F.lit("key"), F.col("x.k")).alias("h2"))
    )


class LineRuns:
    """The runs of one corpus, in the shared folder."""

    def __init__(self, spark: SparkSession, fan: int = 3) -> None:
        self.spark, self.fan, self.buckets = spark, fan, partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self.deltas: list[DataFrame] = []

    def __iter__(self):  # type: ignore[no-untyped-def]
        return (run for level in self.levels for run in level)

    def _store(self, rows: DataFrame) -> DataFrame:
        """A bucketed and sorted table of ``rows``: one file a bucket."""
        path = scratch_dir(self.spark, "run")
        name = "papyra_" + path.rsplit("-", 1)[1]
        dealt = rows.select("h1", "h2", "n", "last").repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def add(self, lines: DataFrame) -> None:
        """Adds a batch (doc_id, h1, h2) of documents that no batch before had."""
        counted = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("_")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        if not self.levels:
            self._level(0, self._store(counted))
            return
        batch = self._store(counted)
        new = self._store(self.unseen(batch))
        self.deltas.append(self._store(batch.join(new.hint("merge"), ["h1", "h2"], "left_anti")))
        if len(self.deltas) >= self.fan:
            self.deltas = [self._store(summed(self.deltas))]
        self._level(0, new)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose keys are in no run: a merge anti-join with each."""
        return reduce(lambda rows, run: rows.join(run.hint("merge"), ["h1", "h2"], "left_anti"), self, batch)

    def _level(self, k: int, run: DataFrame) -> None:
        if len(self.levels) == k:
            self.levels.append([])
        self.levels[k].append(run)
        if len(self.levels[k]) >= self.fan:
            together, self.levels[k] = self.levels[k], []
            self._level(k + 1, self._store(reduce(DataFrame.unionByName, together)))

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys of at least so many documents, with the largest doc_id: each run with what the deltas add to it."""
        runs = list(self)
        if not runs:
            return self.spark.createDataFrame([], RUN)
        if not self.deltas:
            return reduce(DataFrame.unionByName, runs).where(F.col("n") >= min_docs)
        more = summed(self.deltas).withColumnsRenamed({"n": "_n", "last": "_last"})
        both = [run.join(more, ["h1", "h2"], "left").select("h1", "h2", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("last", "_last").alias("last")) for run in runs]
        return reduce(DataFrame.unionByName, both).where(F.col("n") >= min_docs)


def summed(counts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, counts).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def dropped_places(documents: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """For documents (doc_id, text) that lose lines: doc_id, mark of the text, and the places of these lines."""
    lines = written(keyed_lines(documents, min_chars).withColumn("batch", F.pmod(F.hash("doc_id"), F.lit(batches))), "lines", partition_by="batch")
    runs = LineRuns(documents.sparkSession, fan=fan)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select("doc_id", "h1", "h2"))
    last = runs.frequent(min_docs).select("h1", "h2", "last")
    return lines.join(last, ["h1", "h2"]).where("doc_id != last").groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places"))


def dedup(documents: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan: int = FAN, kept: str = "_kept", lines: str | None = None, dropped: str = "_dropped") -> DataFrame:
    """``documents`` with the columns ``kept`` (the text without the dropped lines), ``dropped`` and, if named, ``lines`` (numbers of lines)."""
    key, mark, places = free_names(documents, "_id", "_mark", "_places")
    gone = written(dropped_places(documents.select("doc_id", "text"), min_chars=min_chars, min_docs=min_docs, batches=batches, fan=fan), "dropped").withColumnsRenamed({"doc_id": key, "mark": mark, "places": places})
    with_places = documents.join(gone, (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(mark)), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(places))
    left = F.when(F.col(places).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(parts, i + 1)), "\n"))
    added = {dropped: F.coalesce(F.size(places), F.lit(0)).cast("bigint"), kept: left} | ({lines: F.size(parts).cast("bigint")} if lines else {})
    return with_places.withColumns(added).drop(key, mark, places)
