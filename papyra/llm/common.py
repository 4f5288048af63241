"""What the operators share: row mapping over Arrow, and tables in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_libc = ctypes.CDLL(None)

#: Rows of an input batch that are Python objects at one time.
SLICE = 256

_scratch: list[tuple[SparkSession, str]] = []
_kept: list[tuple[SparkSession, str]] = []


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, finish: bool = False) -> DataFrame:
    """Rows of ``df`` through a function that ``make`` returns once in each partition.

    The function gets a row's values and returns output rows. With ``finish`` it also has an attribute
    ``finish`` that returns the rows left at the partition's end. A few hundred rows are Python objects
    at one time, whatever the size of a batch.
    """
    kind = T._parse_datatype_string(schema)
    assert isinstance(kind, T.StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in pieces(tuple(batch.columns), SLICE):
                rows = [out for row in zip(*(c.to_pylist() for c in part), strict=True) for out in fn(*row)]
                yield from packed(rows, arrow)
        if finish:
            yield from packed(list(fn.finish()), arrow)  # type: ignore[attr-defined]
        fn = batch = part = rows = None
        tidy()

    return df.mapInArrow(run, kind)


def add_columns(df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` after its own, from a function of each row's ``inputs``; no other column leaves the JVM."""

    def each() -> Callable[[list[tuple]], list[tuple]]:
        fn = make()
        return lambda rows: [fn(*row) for row in rows]

    return add_columns_by(df, inputs, each, schema)


def pieces(columns: tuple[pa.Array, ...], rows: int, size: int = 4 << 20) -> Iterator[tuple[pa.Array, ...]]:
    """A batch's columns in slices of at most so many rows, and of so many bytes of text unless one row has more."""
    n = len(columns[0])
    held = np.zeros(n, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
            held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(held), 0
    while at < n:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        stop = max(at + 1, min(stop, at + rows))
        yield tuple(c.slice(at, stop - at) for c in columns)
        at = stop


def add_columns_by(df: DataFrame, inputs: list[str], make: Callable[[], Callable[[list[tuple]], list[tuple]]], schema: str, rows: int = SLICE, size: int = 4 << 20) -> DataFrame:
    """add_columns() with a function of some rows at a time (at most ``rows``, or ``size`` bytes of text), so that it can work on them together."""
    added = T._parse_datatype_string(schema)
    assert isinstance(added, T.StructType)
    clash = {x.lower() for x in df.columns} & {x.lower() for x in added.names}
    assert not clash, f"columns that clash: {clash}"
    new = to_arrow_schema(added)

    def run(batches):  # type: ignore[no-untyped-def]
        fn = make()
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for part in pieces(columns, rows, size):
                out = fn(list(zip(*(c.to_pylist() for c in part), strict=True)))
                yield pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), new, strict=True)], fields=list(new))
        if hasattr(fn, "close"):
            fn.close()
        fn = batch = columns = part = out = None
        tidy()

    if len(inputs) == 1:

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from run(batches)

        udf = F.arrow_udf(one, added)
    else:

        def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            yield from run(batches)

        udf = F.arrow_udf(several, added)
    (held,) = free_names(df, "_new")
    return df.withColumn(held, udf(*inputs)).select(*(F.col(f"`{x}`") for x in df.columns), *(F.col(f"{held}.{x}") for x in added.names))


def tidy() -> None:
    """Gives memory that a task no longer needs back to the machine: a worker without work, kept for later tasks, holds little."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def packed(rows: list[tuple], arrow: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        columns = list(zip(*rows[at : at + size], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, only one machine (as in tests) gets a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("papyra.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="papyra-")
        spark.conf.set("papyra.shared.dir", found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder in the shared one; it goes when the driver ends or, unless it is to be kept, at release()."""
    path = f"{shared_dir(spark)}/papyra/{name}-{uuid.uuid4().hex}"
    (_kept if keep else _scratch).append((spark, path))
    return path


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Deletes a table of written() that nothing will read again."""
    for path in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        delete(table.sparkSession, path)


def scratch() -> list[tuple[SparkSession, str]]:
    """The scratch folders that there are now."""
    return list(_scratch)


def release(folders: list[tuple[SparkSession, str]] | None = None) -> None:
    """Deletes these scratch folders; without any given all there are, kept ones too. Results that read one of them must have been written before."""
    for held in folders if folders is not None else [*_scratch, *_kept]:
        for known in (_scratch, _kept):
            if held in known:
                known.remove(held)
        try:
            delete(*held)
        except Exception:  # the session has ended; its shared folder is the cluster's to clear
            return


atexit.register(release)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """These names, each with as many underscores after it as it takes to clash with no column of ``df``."""
    taken, out = {x.lower() for x in df.columns}, []
    for x in wanted:
        while x.lower() in taken:
            x += "_"
        taken.add(x.lower())
        out.append(x)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


class WordHashes(dict):
    """64-bit hashes of byte strings, kept for words that come again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near values get unrelated results."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive items; empty if there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= _ODD
        out += hashes[j : j + m]
    return mixed(out)
