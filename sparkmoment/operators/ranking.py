"""Caps, fusion, normalisation and grouping of ranked candidates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..skew import grouped_cumsum, grouped_last, grouped_previous, hot_keys, salted_join
from ..store import materialize
from .ranks import values_at

EPSILON = 1e-9
RRF_K = 60


def diversify(candidates: DataFrame, cap: int, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """At most ``cap`` candidates per video, then the ``limit`` best: (…, rank). Ties by vector_id. ``by`` names the keys of many searches at once."""
    per = W.partitionBy(*by, "video_id").orderBy(F.desc("score"), "vector_id")
    kept = candidates.withColumn("in_video", F.row_number().over(per)).filter(F.col("in_video") <= cap)
    if by:
        return top_per_group(kept, list(by), limit)
    return kept.orderBy(F.desc("score"), "vector_id").limit(limit)


def top_per_group(candidates: DataFrame, keys: list[str], m: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "vector_id")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= m)


def video_rerank(candidates: DataFrame, top_videos: int, per_video: int, top_k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Videos by log-sum-exp of their ``top_k`` best frames; of each the ``per_video`` best frames, scored video - rank * 1e-4.

    ``by`` names the keys of many searches at once.
    """
    keys = [*by, "video_id"]
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "vector_id")
    ranked = candidates.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(top_k, per_video))
    peak = F.max("score").over(W.partitionBy(*keys))
    ranked = ranked.withColumn("peak", peak)
    videos = ranked.filter(F.col("r") <= top_k).groupBy(*keys).agg((F.max("peak") + F.log(F.sum(F.exp(F.col("score") - F.col("peak"))))).alias("video_score"))
    if by:
        first = W.partitionBy(*by).orderBy(F.desc("video_score"), "video_id")
        best = videos.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= top_videos).drop("place")
    else:
        best = F.broadcast(videos.orderBy(F.desc("video_score"), "video_id").limit(top_videos))
    return ranked.filter(F.col("r") <= per_video).join(best, keys).select(*by, "video_id", "vector_id", "r", "video_score", (F.col("video_score") - (F.col("r") - 1) * F.lit(1e-4)).alias("score"))


def rrf(lists: DataFrame, k: int | None = RRF_K, longest: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by…, id, score): weighted reciprocal rank fusion of rows (list, id, rank from 1, weight).

    k None takes the adaptive constant 1 + 59 * longest / 2000, half-even rounded, within 1 and 60.
    """
    if k is None:
        k = min(60, max(1, round(1 + 59 * (longest or 0) / 2000)))
    return lists.groupBy(*by, "id").agg(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("score"))


def dynamic_k(longest: int) -> int:
    """Constant for fusing transcript lists: a fifth of the longest list, within 1 and 60."""
    return min(60, max(1, int(0.2 * longest)))


def minmax(x: Column, w: W, flat: float = 1.0) -> Column:
    """(x - min) / (max - min) within the window, for groups that a search has bounded; ``flat`` where all are equal."""
    return scaled(x, F.min(x).over(w), F.max(x).over(w), flat)


def scaled(x: Column, lo: Column, hi: Column, flat: float = 1.0) -> Column:
    return F.when(hi - lo < EPSILON, F.lit(flat)).otherwise((x - lo) / (hi - lo))


def by_extent(df: DataFrame, keys: list[str], x: str, out: str, flat: float = 1.0) -> DataFrame:
    """``df`` with ``out``, x min-max scaled within its group. Bounds are aggregated before anything moves, so groups of any size do."""
    ends = df.groupBy(*keys).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    return salted_join(df, ends, keys, "inner", [x]).withColumn(out, scaled(F.col(x), F.col("__lo"), F.col("__hi"), flat)).drop("__lo", "__hi")


def by_highest(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """``df`` with ``out``, x over the highest of its group; 0 where that isn't positive."""
    ends = df.groupBy(*keys).agg(F.max(x).alias("__hi"))
    return salted_join(df, ends, keys, "inner", [x]).withColumn(out, F.when(F.col("__hi") < EPSILON, F.lit(0.0)).otherwise(F.col(x) / F.col("__hi"))).drop("__hi")


def sigmoid(x: Column, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-x / F.lit(temperature)))


def by_percentile(df: DataFrame, keys: list[str], x: str, out: str, p: float = 90.0) -> DataFrame:
    """x over the group's p-th percentile (linear), clipped to 0..1; groups of one row, or a flat zero, give 1.0."""
    stats = values_at(df, keys, x, {"__p": lambda n: (n - 1) * F.lit(p / 100)}).withColumnRenamed("n", "__n")
    v = F.when((F.col("__n") < 2) | (F.abs(F.col("__p")) < EPSILON), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(x) / F.col("__p"))))
    return salted_join(df, stats, keys, "inner", [x]).withColumn(out, v).drop("__p", "__n")


def modality_fusion(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, score): per-modality min-max, weighted, over the sum of the weights of the modalities that have rows."""
    w = reduce(lambda c, m: c.when(F.col("modality") == m, F.lit(float(weights[m]))), list(weights)[1:], F.when(F.col("modality") == next(iter(weights)), F.lit(float(next(iter(weights.values()))))))
    rows = scores.withColumn("w", w).filter("w > 0")
    rows = by_extent(rows, ["modality"], "score", "s")
    active = rows.select("modality", "w").distinct().agg(F.sum("w").alias("total"))
    return rows.groupBy("id").agg(F.sum(F.col("w") * F.col("s")).alias("s")).crossJoin(F.broadcast(active)).select("id", (F.col("s") / F.col("total")).alias("score"))


def adaptive_rank_fusion(candidates: DataFrame, query: str = "query_id", animal: bool = False) -> DataFrame:
    """Candidates with ``fused``: rank score 1 - r / (n - 1) and concept coverage, weighed by how well the pool is covered.

    Mean coverage under 0.05 gives 0.80 / 0.20, an animal query 0.45 / 0.55, else 0.65 / 0.35. Pools of one row keep their score.
    """
    w = W.partitionBy(query)
    n = F.count(F.lit(1)).over(w)
    r = F.row_number().over(w.orderBy(F.desc("score"), "vector_id")) - 1
    covered = F.avg("coverage").over(w)
    ws = F.when(covered < 0.05, 0.80).otherwise(0.45 if animal else 0.65)
    fused = ws * (1 - r / F.nullif(n - 1, F.lit(0))) + (1 - ws) * F.col("coverage")
    return candidates.withColumn("fused", F.coalesce(fused, F.col("score")))


def islands(rows: DataFrame, keys: list[str], time: str, gap: float) -> DataFrame:
    """Rows with ``island``: number of the session they fall in; a session ends where the next row is more than ``gap`` later.

    Rows of one time fall in one session. A video with a large share of the rows is cut into parts in
    time; null keys make a group of their own.
    """
    hot = hot_keys(rows.select(*keys), keys)
    before = grouped_previous(rows, keys, time, "__before", hot)
    flagged = before.withColumn("__new", F.coalesce((F.col(time) - F.col("__before") > gap).cast("int"), F.lit(0)))
    return grouped_cumsum(flagged, keys, time, F.col("__new"), "island", hot, peers=True).drop("__new", "__before")


def dedupe_temporal(candidates: DataFrame, gap: float = 1.5) -> DataFrame:
    """The best candidate of each session of a video; of equals the first in time."""
    rows = islands(candidates, ["video_id"], "timestamp", gap)
    w = W.partitionBy("video_id", "island").orderBy(F.desc("score"), "timestamp", "vector_id")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "island")


def moments(candidates: DataFrame, gap: float = 3.0, aggregation: str = "max", min_frames: int = 1) -> DataFrame:
    """(video_id, island, start, end, n, score, best): sessions of a video; score by max, mean or lse."""
    rows = islands(candidates, ["video_id"], "timestamp", gap)
    score = {"max": F.max("score"), "mean": F.avg("score"), "lse": F.max("peak") + F.log(F.sum(F.exp(F.col("score") - F.col("peak"))))}[aggregation]
    rows = rows.withColumn("peak", F.max("score").over(W.partitionBy("video_id", "island")))
    best = F.max_by("vector_id", F.struct("score", -F.col("timestamp"), -F.col("vector_id")))
    out = rows.groupBy("video_id", "island").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("n"), score.alias("score"), best.alias("best"))
    return out.filter(F.col("n") >= min_frames)


def moments_with_shots(candidates: DataFrame, gap: float = 3.0) -> DataFrame:
    """(video_id, moment, start, end, n, score): as ``moments``, and a row of the same shot as its moment's first row stays in it.

    Within a session every row stays. A session's first row stays in the moment before it if their
    shots agree, and then the session's shot is the moment's; so the moment's shot is always that of
    its last session, and sessions need only be compared with the ones before them.
    """
    rows = islands(candidates, ["video_id"], "timestamp", gap)
    first = F.min_by(F.col("shot_id"), F.struct("timestamp", "vector_id"))
    sessions = rows.groupBy("video_id", "island").agg(first.alias("shot"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
    sessions = materialize(sessions, "sessions")
    hot = hot_keys(sessions, ["video_id"])
    wrapped = sessions.withColumn("__own", F.struct("shot"))  # never null, so that a session without a shot is seen too
    before = grouped_last(wrapped, ["video_id"], "island", (), "__own", "__before", hot, own=False)
    new = F.when(F.col("__before").isNull() | F.coalesce(F.col("__before.shot") != F.col("shot"), F.lit(True)), 1).otherwise(0)
    numbered = grouped_cumsum(before.withColumn("__new", new), ["video_id"], "island", F.col("__new"), "moment", hot)
    return numbered.groupBy("video_id", (F.col("moment") - 1).alias("moment")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.max("score").alias("score"))


def best_per(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best-scored row per key (ties by vector_id); null keys are dropped."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "vector_id")
    known = reduce(lambda c, k: c & F.col(k).isNotNull(), keys, F.lit(True))
    return rows.filter(known).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
