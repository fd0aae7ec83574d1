"""Windows over usage logs, and streaming ingest. The batch and the streaming form are the same expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.generations import Generations


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by type and time window; a stream needs ``late``, the watermark."""
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """A user's events closer than the gap."""
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", "total")


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str = "source", late: str | None = None):
    """Start a stream that upserts new document files into the table at target (see Generations); each batch writes its own rows only.

    A batch is named by its stream and number, and one that was written before is left alone, so a restart is safe; so is a table that others have
    written to, and a new stream into it. Of rows that share a key in one batch the one of the newest file stays, then the one with the greatest hash. With ``late`` a text that was met
    under any key within that time of the newest file is not written again: the stream keeps hashes of texts as state, until the watermark has passed them.
    """
    at = spark.readStream.schema(schema).parquet(source).select("*", F.col("_metadata.file_modification_time").alias("_mtime")).withColumn("hash", F.md5("text"))
    at = at.withWatermark("_mtime", late).dropDuplicatesWithinWatermark(["hash"]) if late else at
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def upsert(batch: DataFrame, epoch: int) -> None:
        columns = [c for c in batch.columns if c not in (key, "_mtime")]
        new = batch.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("_mtime", "hash")).alias("r")).select(key, "r.*")
        Generations(spark, target, key).append(new, tag=f"{name}-{epoch}")

    return at.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str = "source") -> DataFrame | None:
    """The table that ``ingest`` writes, or None."""
    return Generations(spark, target, key).read()
