"""Evidence from detector labels: coverage of requested concepts, constraints, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.records import label_in_part
from ..functions.text import fold

KEEP, PRESENT = 0.3, 0.4


def coverage(labels: Column, concepts: list[str]) -> Column:
    """Share of the concepts among the labels; null for no concepts."""
    if not concepts:
        return F.lit(None).cast("double")
    have = F.array_intersect(F.coalesce(labels, F.array().cast("array<string>")), F.array(*map(F.lit, sorted(set(concepts)))))
    return F.size(have) / F.lit(float(len(set(concepts))))


def evidence_adjustment(cov: Column, weight: float = 0.03, penalty: float = 2.0) -> Column:
    """-weight * penalty without coverage, else weight * (2 * coverage - 1); null for no concepts."""
    return F.when(cov == 0, F.lit(-weight * penalty)).when(cov > 0, weight * (2 * cov - 1))


def requires_all(labels: Column, groups: list[list[str]]) -> Column:
    """Whether the labels hold every concept of at least one group."""
    have = F.coalesce(labels, F.array().cast("array<string>"))
    out = F.lit(False)
    for g in groups:
        out = out | (F.size(F.array_except(F.array(*map(F.lit, sorted(set(g)))), have)) == 0)
    return out


def compare_count(n: Column, op: str, want: int) -> Column:
    return {"==": n == want, ">": n > want, ">=": n >= want, "<": n < want, "<=": n <= want}[op]


def verify_constraints(frames: DataFrame, attribute: str, subject: str, op: str, count: int) -> DataFrame:
    """(video_id, delta): +.03 / -.05 for the attribute, +.03 / -.06 for the count of frames with the subject.

    Videos without any labelled frame get 0.
    """
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    g = frames.groupBy("video_id").agg(
        F.bool_or(F.size(labels) > 0).alias("labelled"),
        F.bool_or(F.array_contains(labels, attribute)).alias("has"),
        F.count_if(F.array_contains(labels, subject)).alias("n"),
    )
    delta = F.when(F.col("has"), 0.03).otherwise(-0.05) + F.when(compare_count(F.col("n"), op, count), 0.03).otherwise(-0.06)
    return g.select("video_id", F.when(F.col("labelled"), delta).otherwise(0.0).alias("delta"))


def kept_labels(entities: Column, scores: Column) -> Column:
    """Sorted distinct entities scored 0.3 or more, provided one is scored 0.4 or more; an unreadable score counts 1."""
    pairs = F.zip_with(F.coalesce(entities, F.array().cast("array<string>")), F.coalesce(scores, F.array().cast("array<string>")), lambda e, s: F.struct(e.alias("e"), F.coalesce(s.try_cast("double"), F.lit(1.0)).alias("s")))
    pairs = F.filter(pairs, lambda p: p["e"].isNotNull())
    strong = F.exists(pairs, lambda p: p["s"] >= PRESENT)
    kept = F.transform(F.filter(pairs, lambda p: p["s"] >= KEEP), lambda p: p["e"])
    return F.when(strong, F.array_sort(F.array_distinct(kept))).otherwise(F.array().cast("array<string>"))


def _has_label(labels: str, subject: str) -> Column:
    """Whether the subject stands in a label as whole words; letter case and accents don't matter."""
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return F.exists(labels, lambda x: F.contains(padded(fold(x)), padded(fold(F.lit(subject)))))


def verify_all(candidates: DataFrame, frames: DataFrame, constraints: list[tuple[str, str, str, int]]) -> DataFrame:
    """Candidates (video_id, score, ...) with the score moved by how their video's labelled frames satisfy any number of constraints.

    ``constraints`` are (kind, subject, operator, value) as query understanding gives them: an attribute
    adds .03 where a frame's labels show the subject, else takes .05 off; a count of frames that show it
    adds .03 or takes .06 off. Subjects without a word are passed over; videos without labels keep their score.
    """
    wanted = [c for c in constraints if c[1].strip()]
    if not wanted:
        return candidates
    labelled = frames.filter(F.size(F.coalesce("labels", F.array().cast("array<string>"))) > 0)
    shown = [label_in_part(F.col("labels"), s) | _has_label("labels", s) for _, s, _, _ in wanted]
    counts = labelled.groupBy("video_id").agg(*(F.count_if(F.coalesce(x, F.lit(False))).alias(f"n{i}") for i, x in enumerate(shown)))
    delta = F.lit(0.0)
    for i, (kind, _, op, value) in enumerate(wanted):
        n = F.col(f"n{i}")
        delta = delta + (F.when(n > 0, 0.03).otherwise(-0.05) if kind == "attribute" else F.when(compare_count(n, op, value), 0.03).otherwise(-0.06))
    moved = counts.select("video_id", delta.alias("__delta"))
    return candidates.join(moved, "video_id", "left").withColumn("score", F.col("score") + F.coalesce("__delta", F.lit(0.0))).drop("__delta")


def adjustment_matrix(frames: DataFrame, events: DataFrame, weight: float = 0.08, penalty: float = 2.0) -> DataFrame:
    """(vector_id, event, adjustment) of every frame for every event of a query; ``events`` has (event, concepts), few rows.

    An event without concepts, and a frame without any of an event's, takes weight * penalty off.
    """
    have = F.size(F.array_intersect(F.coalesce("labels", F.array().cast("array<string>")), F.array_distinct("concepts")))
    share = have / F.nullif(F.size(F.array_distinct("concepts")), F.lit(0))
    rows = frames.select("vector_id", "labels").crossJoin(F.broadcast(events.select("event", "concepts")))  # a query's events
    return rows.select("vector_id", "event", F.coalesce(evidence_adjustment(share, weight, penalty), F.lit(-weight * penalty)).alias("adjustment"))
