"""Documents that arrive over time: each is taken in once, however often its file comes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType


def ingest(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str) -> StreamingQuery:
    """Starts taking the Parquet files of ``source`` into ``target``, all there are now, and returns the query.

    A batch is a folder ``source=X/batch=N`` of the target, X a name for the checkpoint; a repeated attempt overwrites it, so that
    a batch which failed half way leaves nothing twice, and a new checkpoint over an old target adds to it. Documents whose
    doc_id the target holds from any other batch stay out (ids alone are read again); of several with one id in a batch,
    the one with the smallest text goes in. Rows without an id are dropped.
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    origin = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def take(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        rest = [c for c in kind.names if c not in ("doc_id", "text")]
        new = batch.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("r")).select("doc_id", "r.*")
        at = own._jvm.org.apache.hadoop.fs.Path(target)
        if at.getFileSystem(own._jsc.hadoopConfiguration()).exists(at):
            held = own.read.schema(StructType([*kind.fields, StructField("source", StringType()), StructField("batch", LongType())])).option("basePath", target).parquet(target)
            new = new.join(held.where(~((F.col("source") == origin) & (F.col("batch") == n))).select("doc_id"), "doc_id", "left_anti")
        new.select(*kind.names).write.mode("overwrite").parquet(f"{target}/source={origin}/batch={n}")

    stream = spark.readStream.schema(kind).parquet(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
