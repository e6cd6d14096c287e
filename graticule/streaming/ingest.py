"""Incremental granule ingest with deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graticule.sources.metadata import parse_granules


def read_record_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Folder of JSON-lines record files → stream of ``raw, received_at``."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
        .select(F.col("value").alias("raw"),
                F.col("_metadata.file_modification_time").alias("received_at"))
    )


def ingest_granules(records: DataFrame, delay: str = "7 days") -> DataFrame:
    """Stream of ``raw, received_at`` → parsed granules, one per ``concept_id``.

    A record seen again within ``delay`` of its first arrival is dropped; keys older than
    that leave the state, which therefore stays as large as one delay's worth of ids.
    """
    marked = records.withWatermark("received_at", delay)
    ids = marked.withColumn("concept_id", F.get_json_object("raw", "$.meta.concept-id"))
    return parse_granules(ids.dropDuplicatesWithinWatermark(["concept_id"]))


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch to its own folder, so a replayed batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
