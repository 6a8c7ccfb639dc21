"""Incremental corpus building: resumable materialization, a ledger with a derived index, windowed counts.

State lives in the query's checkpoint and in the target table; a batch that is run again replaces
what it wrote, by its batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import adapters, annotation
from ..operators.dedup import first_wins


def materialize(spark: SparkSession, raw: str, target: str, checkpoint: str, source: str, split: str = "train", max_files: int = 64) -> StreamingQuery:
    """Normalize the raw lines that have come since the last run, then stop; exactly once by batch."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(raw).where("trim(value) <> ''").select(F.col("value").alias("raw"))

    def write(batch: DataFrame, number: int) -> None:
        adapters.normalize(batch, source, split).withColumn("batch", F.lit(number)).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def materialized(spark: SparkSession, target: str) -> DataFrame:
    """All committed batches, the first of equal canonical rows kept; rejects are counted apart by ``adapters.ledger``."""
    rows = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    valid = first_wins(rows.where("status = 'VALID'"), F.col("canonical_hash"), ["batch", "id", "raw_hash"], "id")
    return valid.where("kept").drop("kept", "duplicate_of")


def ledger_index(spark: SparkSession, events: str, schema: str, checkpoint: str, key: str, order: list[str], publish: Callable[[DataFrame], None]) -> StreamingQuery:
    """Follow an append-only JSONL ledger; after each batch the whole index is derived again and published."""
    stream = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(events)

    def rebuild(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            publish(annotation.latest(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(events).where(F.col(key).isNotNull()), key, order))

    return stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window; works on a stream (with a watermark) and on a table alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
