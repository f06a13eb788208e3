"""Ordered-event alignment: one frame per event, in order, within a video.

The dynamic programme over positions is a chain of running maxima: the best way to reach event e at a
position is the best way to reach event e - 1 at an earlier one. Each event is one window over the
video's frames, all windows share one partitioning and order, so the whole alignment takes one
shuffle. A path array rides along in the maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..skew import grouped_places

PENALTY = 0.005
#: Decay per normalised step by how the query words it.
DECAY = {"immediate": 0.05, "then": 0.01, "later": 0.002}


def positions(frames: DataFrame) -> DataFrame:
    """Frames with ``pos``, 0, 1, ... per video in frame order; frames without a number come first."""
    return grouped_places(frames, ["video_id"], "frame_id", ["vector_id"], "pos")


def similarities(scored: DataFrame, n_events: int) -> DataFrame:
    """Wide rows (video_id, pos, s0, s1, ...) from long rows (video_id, pos, event, score)."""
    cols = [F.max(F.when(F.col("event") == e, F.col("score"))).alias(f"s{e}") for e in range(n_events)]
    return scored.groupBy("video_id", "pos").agg(*cols)


def align(sim: DataFrame, n_events: int, penalty: float = PENALTY, decay: float = 0.0) -> DataFrame:
    """(video_id, score, path): best strictly increasing positions of the events.

    score = sum of similarities - penalty * sum of gaps; ties go to the earliest predecessor and the
    earliest end. ``decay`` takes decay * (step as a share of the video's positions) off after each
    predecessor is chosen. Videos with fewer frames than events are left out.
    """
    w = W.partitionBy("video_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    video = W.partitionBy("video_id")
    span = F.max("pos").over(video) - F.min("pos").over(video)
    rows = sim.withColumn("span", F.when(span == 0, F.lit(1)).otherwise(span).cast("double")) if decay else sim
    rows = rows.withColumn("d", F.col("s0")).withColumn("path", F.array(F.col("pos")))
    for e in range(1, n_events):
        state = F.struct((F.col("d") + penalty * F.col("pos")).alias("v"), (-F.col("pos")).alias("n"), F.col("path").alias("p"))
        rows = rows.withColumn("b", F.max(F.when(F.col("d").isNotNull(), state)).over(w))
        d = F.col(f"s{e}") + F.col("b.v") - penalty * F.col("pos")
        if decay:
            d = d - decay * (F.col("pos") + F.col("b.n")) / F.col("span")
        rows = rows.withColumn("d", d).withColumn("path", F.concat("b.p", F.array(F.col("pos")))).drop("b")
    done = rows.filter("d is not null").groupBy("video_id").agg(F.max(F.struct("d", (-F.col("pos")).alias("n"), "path")).alias("x"))
    return done.select("video_id", F.col("x.d").alias("score"), F.col("x.path").alias("path"))


def by_role(sim: DataFrame, event: int, role: str) -> DataFrame:
    """(video_id, pos) of one event by its role: ``last`` the position of the maximum, ``first`` the earliest within 1e-6 of it."""
    s = F.col(f"s{event}")
    rows = sim.withColumn("top", F.max(s).over(W.partitionBy("video_id")))
    near = rows.filter(s >= F.col("top") - 1e-6) if role == "first" else rows.filter(s == F.col("top"))
    return near.groupBy("video_id").agg(F.min("pos").alias("pos"))


def lambdas(path: Column, alpha: float) -> Column:
    """1, then exp(-alpha * step) for the path's steps as shares of its length."""
    lo, hi = F.array_min(path), F.array_max(path)
    share = F.transform(path, lambda p: F.when(hi == lo, p.cast("double")).otherwise((p - lo) / (hi - lo)))
    return F.transform(share, lambda x, i: F.when(i == 0, F.lit(1.0)).otherwise(F.exp(-alpha * (x - F.element_at(share, i.cast("int"))))))


def gating(scores: Column, weights: Column) -> Column:
    """Sum of score * lambda; a missing lambda counts 1."""
    return F.aggregate(F.zip_with(scores, weights, lambda s, w: s * F.coalesce(w, F.lit(1.0))), F.lit(0.0), lambda a, x: a + x)


def decay_from_wording(text: str) -> float:
    """Decay by the words of the query: immediately, later, then (checked in this order), else that of then."""
    folded = text.casefold()
    for name, words in (("immediate", ("immediately", "right after", "ngay sau", "ngay lập tức")), ("later", ("later", "sau này", "về sau")), ("then", ("then", "sau đó", "rồi"))):
        if any(w in folded for w in words):
            return DECAY[name]
    return DECAY["then"]


def window_frames(centres: Column, radius: int, stride: int, last: Column) -> Column:
    """Sorted distinct frame numbers around each centre: every ``stride``-th, the bounds and the centre, within 0..last."""
    one = lambda c: F.concat(F.sequence(F.greatest(F.lit(0), c - radius), F.least(last, c + radius), F.lit(stride)), F.array(c, F.least(last, c + radius)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(centres, one))))
