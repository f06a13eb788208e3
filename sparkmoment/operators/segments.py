"""Segments: runs of a video's frames with one pooled vector, searched and taken apart again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..skew import salted_join
from . import vector as V


def build_segments(frames: DataFrame, n: int, overlap: int = 0, pool: str = "mean") -> DataFrame:
    """(video_id, seg, vec, members, first_frame, last_frame): tiles of n frames, pooled by mean, max, topk or weighted.

    ``members`` are the vector ids in frame order, n at most. Frames without a vector count for the tile but not for its vector.
    """
    tiled = V.tiles(frames, n, overlap)
    keys = ["video_id", "seg"]
    pooled = {"mean": lambda: V.mean_pool(tiled, keys), "max": lambda: V.max_pool(tiled, keys), "topk": lambda: V.near_mean_pool(tiled, keys, 0.5), "weighted": lambda: V.near_mean_pool(tiled, keys, None)}[pool]()
    members = tiled.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "vector_id", "frame_id"))).alias("m"))  # n at most
    members = members.select(*keys, F.transform("m", lambda x: x["vector_id"]).alias("members"), F.element_at("m", 1)["frame_id"].alias("first_frame"), F.element_at("m", -1)["frame_id"].alias("last_frame"))
    return salted_join(members, pooled, keys, "inner", ["members"])


def search_segments(segments: DataFrame, queries: DataFrame, k: int, videos: DataFrame | None = None) -> DataFrame:
    """(query_id, video_id, seg, members, score, rank): the k segments most similar to each query; ties by video and segment.

    ``videos`` (video_id) limits the segments before anything is scored.
    """
    some = segments if videos is None else segments.join(videos, "video_id", "left_semi")
    hits = V.scored(some.withColumn("vector_id", F.xxhash64("video_id", "seg")), queries).withColumn("score", F.round("score", 9))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "video_id", "seg")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "video_id", "seg", "members", "score", "rank")


def frames_of(hits: DataFrame) -> DataFrame:
    """(query_id, vector_id, place): the hits' frames, each once, in the order of the hits and within them."""
    rows = hits.select("query_id", "rank", F.posexplode("members").alias("pos", "vector_id"))
    first = rows.groupBy("query_id", "vector_id").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return first.select("query_id", "vector_id", F.row_number().over(W.partitionBy("query_id").orderBy("at")).alias("place"))
