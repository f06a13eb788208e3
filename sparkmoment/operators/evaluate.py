"""Retrieval metrics and submission rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ranks import values_at

CUTOFFS = (1, 5, 20, 50, 100)


def is_hit(video: Column, frame: Column, gt_video: Column, gt_frame: Column, tolerance: int = 50) -> Column:
    """Same video, and within ``tolerance`` frames where the truth names a frame."""
    return F.coalesce((video == gt_video) & (gt_frame.isNull() | (F.abs(frame - gt_frame) <= tolerance)), F.lit(False))


def recalls(ranked: DataFrame, query: str, cutoffs=CUTOFFS) -> DataFrame:
    """Per query: whether (best relevance) a hit is among the first k for each cut-off, and their mean as ``final``.

    ``ranked`` has (query, rank from 1, relevance).
    """
    best = [F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("relevance"))), F.lit(0.0)).alias(f"r{k}") for k in cutoffs]
    out = ranked.groupBy(query).agg(*best)
    return out.withColumn("final", sum((F.col(f"r{k}") for k in cutoffs), F.lit(0.0)) / len(cutoffs))


def average_precision(ranked: DataFrame, query: str) -> DataFrame:
    """(query, ap): mean over the list's hits of the precision at each; 0 without hits."""
    w = W.partitionBy(query).orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = (F.col("relevance") > 0).cast("double")
    rows = ranked.withColumn("hit", hit).withColumn("p", F.sum("hit").over(w) / F.col("rank"))
    return rows.groupBy(query).agg(F.coalesce(F.sum(F.col("hit") * F.col("p")) / F.nullif(F.sum("hit"), F.lit(0.0)), F.lit(0.0)).alias("ap"))


def latency_quantiles(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Median and the 19th of 20 cut points by the exclusive method: (keys..., n, p50, p95).

    The exclusive point is at .95 (n + 1), counted from 1, within the values there are.
    """
    return values_at(df, keys, x, {"p50": lambda n: (n - 1) * F.lit(0.5), "p95": lambda n: F.greatest(F.lit(0.95) * (n + 1), F.lit(1.0)) - 1})


def csv_field(answer: Column) -> Column:
    """The answer, quoted only where it holds a comma, a quote, a line break or blanks at its ends."""
    need = answer.rlike(r"[,\"\r\n]") | (F.regexp_replace(answer, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "") != answer)
    return F.when(need, F.concat(F.lit('"'), F.replace(answer, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(answer)


def csv_row(video: Column, frames: Column, answer: Column | None = None) -> Column:
    """One submission line: video, frames and, for questions, the answer."""
    parts = [video, F.array_join(F.transform(frames, lambda f: f.cast("string")), ",")]
    return F.concat_ws(",", *parts, *([csv_field(answer)] if answer is not None else []))


def answers_match(predicted: Column, gold: Column, prefix: str = "màu ") -> Column:
    """Equal normalised answers, also without the colour prefix; empty ones never match."""
    strip = lambda c: F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)
    return F.coalesce((predicted != "") & (gold != "") & ((predicted == gold) | (strip(predicted) == strip(gold))), F.lit(False))


def relevance(video: Column, frames: Column, answer: Column, gt_video: Column, ranges: Column, gt_answer: Column, task: str) -> Column:
    """0..1: 0 in another video. Ordered events: the share of them within their ranges, 0 unless as many; else whether a
    frame is in any range, and for questions whether the answers match too. Ranges are structs (lo, hi), ends included."""
    within = lambda f, r: (f >= r["lo"]) & (f <= r["hi"])
    if task == "trake":
        pairs = F.zip_with(frames, ranges, lambda f, r: F.coalesce(within(f, r), F.lit(False)).cast("double"))
        value = F.when((F.size(frames) == F.size(ranges)) & (F.size(frames) > 0), F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.size(frames)).otherwise(0.0)
    else:
        hit = F.exists(ranges, lambda r: F.exists(frames, lambda f: within(f, r)))
        value = F.when(hit & (answers_match(answer, gt_answer) if task == "qa" else F.lit(True)), 1.0).otherwise(0.0)
    return F.when(F.coalesce(video == gt_video, F.lit(False)), F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def same_meaning(predicted: Column, gold: Column, groups: list[list[str]]) -> Column:
    """Equal normalised answers, or both of one group of synonyms; empty ones never match."""
    out = predicted == gold
    for g in groups:
        out = out | (predicted.isin(g) & gold.isin(g))
    return F.coalesce(out & (predicted != "") & (gold != ""), F.lit(False))


def with_rates(candidates: DataFrame, videos: DataFrame) -> DataFrame:
    """Candidates (video_id, frame_id, ...) with their video's ``fps`` and their ``seconds``; null where the rate is unknown."""
    rates = videos.groupBy("video_id").agg(F.max("fps").alias("fps"))
    fine = F.when(F.col("fps") > 0, F.col("fps"))
    return candidates.join(rates, "video_id", "left").withColumns({"fps": fine, "seconds": F.col("frame_id") / fine})
