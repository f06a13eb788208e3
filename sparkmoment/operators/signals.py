"""Small scores and checks around a ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..skew import grouped_last
from ..store import materialize
from .ranking import minmax

#: Weights of the linear ranker for its six features.
LINEAR = (0.04, 0.08, 0.30, 0.25, 0.40, 0.12)


def linear_rank(features: list[Column]) -> Column:
    """Linear blend of six features; missing ones count 0."""
    return sum((F.lit(w) * F.coalesce(f, F.lit(0.0)) for w, f in zip(LINEAR, features, strict=True)), F.lit(0.0))


def bounded_bonus(score: Column, term: Column, w: W, weight: float, most: float = 0.02) -> Column:
    """score + min(most, weight * min-max of the term) where there is a term (flat: 0.5); others keep their score."""
    return score + F.coalesce(F.least(F.lit(most), weight * F.when(term.isNotNull(), minmax(term, w, 0.5))), F.lit(0.0))


def fused_with_remote(local: Column, remote: Column) -> Column:
    """0.65 local + 0.35 remote where the remote ranker gave a score."""
    return F.coalesce(0.65 * local + 0.35 * remote, local)


def verified(score: Column, failed: Column) -> Column:
    """Score times 0.7 for one failed detail, 0.3 for more."""
    return score * F.when(failed >= 2, 0.3).when(failed == 1, 0.7).otherwise(1.0)


def confidence_gap(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., gap): best score less the second best, 1.0 where there is no second."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"))
    top = scores.withColumn("__r", F.row_number().over(w)).filter("__r <= 2")
    return top.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("__r") == 1, F.col("score"))) - F.max(F.when(F.col("__r") == 2, F.col("score"))), F.lit(1.0)).alias("gap"))


def event_coverage(matches: DataFrame, events: DataFrame) -> DataFrame:
    """(query_id, video_id, matched, coverage, weighted): share of a query's events with a key word in a match, plain and by importance.

    ``events`` has (query_id, event_index, word, importance), ``matches`` (query_id, video_id, folded).
    """
    total = events.select("query_id", "event_index", "importance").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.sum("importance").alias("weight"))
    hit = matches.join(events, "query_id").filter(F.contains("folded", "word")).select("query_id", "video_id", "event_index", "importance").distinct()
    got = hit.groupBy("query_id", "video_id").agg(F.count(F.lit(1)).alias("matched"), F.sum("importance").alias("w"))
    return got.join(total, "query_id").select("query_id", "video_id", "matched", (F.col("matched") / F.col("total")).alias("coverage"), F.coalesce(F.col("w") / F.nullif("weight", F.lit(0.0)), F.lit(0.0)).alias("weighted"))


def _turned(b: np.ndarray) -> int:
    """Pairs whose first value is larger than their second, by halves."""
    if len(b) <= 64:
        return int(np.triu(b[:, None] > b[None, :], 1).sum())
    half = len(b) // 2
    left, right = b[:half], b[half:]
    return _turned(left) + _turned(right) + int((half - np.searchsorted(np.sort(left), right, "right")).sum())


def order_share(rows: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """(keys..., tau): (Kendall's tau + 1) / 2 of two orders, ties counted as agreeing; 1 for fewer than two rows.

    A group is the matches of one query and video, as many as a search returns; its pairs in the other
    order are counted by halves, not pair by pair. Rows without both values are left out.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fine = rows.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*keys, F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        b = pdf.b.to_numpy()[np.lexsort((pdf.b.to_numpy(), pdf.a.to_numpy()))]
        n = len(b)
        return pdf[keys].head(1).assign(tau=1.0 if n < 2 else 1 - _turned(b) / (n * (n - 1) / 2))

    return fine.groupBy(*keys).applyInPandas(one, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", tau double")


def forward_frames(targets: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., target, frame_id): the first frame at or after each target time; targets after the last frame are left out.

    Both sides are one sequence per video, backwards in time, in which each target looks back at the last
    frame. A hot video is worked on in parts. Rows with a null time take no part.
    """
    t = targets.select(*keys, F.col("t"), F.col("target"), F.lit(None).cast("bigint").alias("frame_id"))
    f = frames.select(*keys, F.col("t"), F.lit(None).cast("bigint").alias("target"), F.col("frame_id"))
    # At equal times the frames come before the target, the first of them last, so that it is seen.
    both = t.unionByName(f).filter("t is not null").withColumns({"back": -F.col("t"), "kind": F.col("target").isNotNull().cast("int"), "against": -F.col("frame_id")})
    both = materialize(both, "sequence")
    seen = grouped_last(both, keys, "back", ["kind", "against"], "frame_id", "next")
    return seen.filter("target is not null and next is not null").select(*keys, "target", F.col("next").alias("frame_id"))


def request_key(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Struct (h in degrees, s, v) of colours 0..255; grey has hue 0."""
    r, g, b = (x / F.lit(255.0) for x in (r, g, b))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    h = F.when(d == 0, 0.0).when(hi == r, F.pmod((g - b) / F.nullif(d, F.lit(0.0)), F.lit(6.0))).when(hi == g, (b - r) / F.nullif(d, F.lit(0.0)) + 2).otherwise((r - g) / F.nullif(d, F.lit(0.0)) + 4)
    return F.struct((h * 60).alias("h"), F.when(hi == 0, 0.0).otherwise(d / F.nullif(hi, F.lit(0.0))).alias("s"), hi.alias("v"))


def hue_between(h: Column, lo: float, hi: float) -> Column:
    """Circular interval test."""
    return h.between(lo, hi) if lo <= hi else (h >= lo) | (h <= hi)
