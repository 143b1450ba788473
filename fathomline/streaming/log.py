"""The message log as a stream: replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import history

SCHEMA = "conv_id string, branch_id string, msg_id long, role tinyint, ts double, token_count int, parent_msg_id long, content string"
STORED = SCHEMA + ", content_hash binary, simhash_i64 long, chain_prev binary, chain_hash binary"
_ORDER = [c.strip().split()[0] for c in STORED.split(",")]
#: Folders of the log; a conversation's rows are in one of them, by the hash of its id.
BUCKETS = 256


def _bucket():
    return F.pmod(F.xxhash64("conv_id"), F.lit(BUCKETS)).cast("int")


def _read(spark, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], STORED + ", bucket int")
    return spark.read.schema(STORED + ", bucket int").parquet(path)


def stored(spark, path: str) -> DataFrame:
    """The log written so far; empty where its folder does not exist. Any other fault in reading it is an error."""
    return _read(spark, path).drop("bucket")


def append_batch(batch: DataFrame, path: str) -> None:
    """Rows whose key is not stored yet, chained after their thread's tip, are added.

    Only the folders of the batch's own conversations are read, and of them
    keys and hashes, which Spark's partition and column pruning sees to.
    """
    spark = batch.sparkSession
    touched = [r.b for r in batch.select(_bucket().alias("b")).distinct().collect()]  # at most BUCKETS
    known = _read(spark, path).filter(F.col("bucket").isin(touched)).select(*history.KEY, "chain_hash")
    new = history.append(known, batch)
    new.select(*[F.col(c) for c in _ORDER], _bucket().alias("bucket")).write.mode("append").partitionBy("bucket").parquet(path)


def run_log(source: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of messages to the log at ``path``; a batch that is replayed finds its keys stored."""
    writer = source.writeStream.foreachBatch(lambda batch, _: append_batch(batch, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def thread_activity(source: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Messages and tokens of each conversation in windows of time, late rows up to ``late``."""
    rows = source.withColumn("at", F.timestamp_seconds(F.col("ts")))
    return rows.withWatermark("at", late).groupBy(F.window("at", window), "conv_id").agg(F.count("*").alias("messages"), F.sum("token_count").alias("tokens"))
