"""Incremental indexing of a stream of page files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.index import frequencies_of, stemmed_tokens, token_lists
from siltworks.session import path_exists

#: Bytes of files that one batch takes; a batch costs seconds however little it holds.
BATCH_BYTES = 128 << 20


def index_stream(spark: SparkSession, source: str, schema, index: str, checkpoint: str, key: str = "url", text: str = "content", batch_bytes: int = BATCH_BYTES):
    """Start a query that indexes all page files present in ``source`` and those that keys already indexed don't cover.

    Batches hold files of up to ``batch_bytes``, one file at least, oldest first. Each batch drops keys that the index
    has, keeps the first row of each key (oldest file, then path, then place), and appends postings and keys partitioned
    by batch; a batch that is run again after a failure replaces its own partition, so nothing counts twice. State is
    the stored key set, not the stream's.
    """
    place = [F.col(f"_metadata.{c}").alias(f"__{c}") for c in ("file_modification_time", "file_path", "row_index")]

    def merge(batch: DataFrame, number: int) -> None:
        order = F.struct("__file_modification_time", "__file_path", "__row_index")
        fresh = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(text, order).alias(text))
        if path_exists(spark, f"{index}/keys"):
            done = spark.read.schema(f"`{key}` {dict(batch.dtypes)[key]}, batch long").parquet(f"{index}/keys").where(F.col("batch") != number)
            fresh = fresh.join(done.select(key), key, "left_anti")
        fresh = token_lists(fresh, key, text).persist()
        frequencies_of(stemmed_tokens(fresh, key), key).write.mode("overwrite").parquet(f"{index}/postings/batch={number}")
        fresh.select(key).write.mode("overwrite").parquet(f"{index}/keys/batch={number}")
        fresh.unpersist()

    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(source).select(key, text, *place)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type with a watermark for late rows; works on streams and on tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")
