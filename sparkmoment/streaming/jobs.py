"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def moments_stream(candidates: DataFrame, gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """Moments of a stream of candidates (video_id, ts, score): session windows per video, complete once the watermark has passed.

    Rows later than ``late`` behind the newest are dropped. A session ends where no row follows within ``gap``.
    """
    w = F.session_window("ts", gap)
    return candidates.withWatermark("ts", late).groupBy("video_id", w).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score")).select("video_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "score")


def counts_stream(rows: DataFrame, keys: Sequence[str], window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows per tumbling (or, with ``slide``, sliding) window and keys."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.withWatermark("ts", late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def distinct_frames_stream(frames: DataFrame, late: str = "1 hour") -> DataFrame:
    """Re-delivered frames (same video and frame) dropped while their first delivery is within the watermark."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(["video_id", "frame_id"])


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: str) -> StreamingQuery:
    """Catalog kept by a stream: each batch's latest row per key is added under its batch number.

    A batch that is run again overwrites its own folder, so nothing is added twice; ``latest_catalog``
    reads the current state.
    """

    def add(batch: DataFrame, number: int) -> None:
        best = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_catalog(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The latest row per key over all batches; of equals the later batch's."""
    cols = [c for c in df.columns if c != "batch"]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(order, "batch")).alias("r")).select("r.*")
