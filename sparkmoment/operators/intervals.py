"""Continuous periods and gaps of overlapping intervals, from independently ranked starts and ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import VIDEO_KEY_SQL, millis, video_key
from ..skew import grouped_cumsum
from ..store import materialize
from ..tables import table


def ranked_bounds(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows (keys..., rank, next_start, current_end) of the entity's bounds.

    Starts and ends are ranked independently of each other. Equal bounds are counted before they are
    ranked; of an end, the last of its ranks i counts, of a start the first of its ranks i + 1. One
    row per i at which either exists: current_end is the i-th end, next_start the (i+1)-th start,
    i = 0 and i = n have only one of them. A gap exists where next_start > current_end.

    Rows with a null bound or end <= start are no intervals. Entities may be null keys.
    """
    keys = list(keys)
    good = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))
    bounds = good.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("__is_end"), F.col(start).alias("__x")), F.struct(F.lit(1).alias("__is_end"), F.col(end).alias("__x")))).alias("__b"))
    counted = bounds.groupBy(*keys, F.col("__b.__is_end").alias("__is_end"), F.col("__b.__x").alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    counted = materialize(counted, "bounds")  # read for hot entities, their cuts and their sums
    ranked = grouped_cumsum(counted, [*keys, "__is_end"], "__x", F.col("__n"), "__upto")
    rank = F.when(F.col("__is_end") == 1, F.col("__upto")).otherwise(F.col("__upto") - F.col("__n"))
    return ranked.groupBy(*keys, rank.alias("rank")).agg(F.max(F.when(F.col("__is_end") == 0, F.col("__x"))).alias("next_start"), F.max(F.when(F.col("__is_end") == 1, F.col("__x"))).alias("current_end"))


def interval_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Uncovered stretches (keys..., gap_start, gap_end) between an entity's first start and last end; touching leaves none."""
    r = ranked_bounds(df, keys, start, end)
    return r.filter(F.col("next_start") > F.col("current_end")).select(*keys, F.col("current_end").alias("gap_start"), F.col("next_start").alias("gap_end"))


def interval_periods(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Continuous periods (keys..., period_start, period_end): the k-th opening bound paired with the k-th closing one."""
    keys = list(keys)
    r = materialize(ranked_bounds(df, keys, start, end), "ranked")
    bound = lambda is_end, x: F.struct(F.lit(is_end).alias("__is_end"), F.col(x).alias("__x"))
    inner = r.filter(F.col("next_start") > F.col("current_end"))
    outer = r.groupBy(*keys).agg(F.min("next_start").alias("next_start"), F.max("current_end").alias("current_end"))
    edges = inner.select(*keys, "next_start", "current_end").unionByName(outer)
    edges = edges.select(*keys, F.explode(F.array(bound(0, "next_start"), bound(1, "current_end"))).alias("__b")).select(*keys, "__b.__is_end", "__b.__x")
    numbered = grouped_cumsum(materialize(edges, "edges"), [*keys, "__is_end"], "__x", F.lit(1).cast("bigint"), "__k")
    return numbered.groupBy(*keys, "__k").agg(F.max(F.when(F.col("__is_end") == 0, F.col("__x"))).alias("period_start"), F.max(F.when(F.col("__is_end") == 1, F.col("__x"))).alias("period_end")).drop("__k")


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    def one(name: str, start: str, end: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("src"), video_key("video_id").alias("video_id"), millis(start).alias("s"), millis(end).alias("e"))

    return one("shots", "start_s", "end_s").unionByName(one("moments", "start_time", "end_time")).filter("video_id is not null")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    gaps = interval_gaps(_intervals(spark, d), ["src", "video_id"], "s", "e")
    return gaps.select("src", "video_id", F.col("gap_start").alias("gap_start_ms"), F.col("gap_end").alias("gap_end_ms"))


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods of shots and of moments per video, in milliseconds."""
    periods = interval_periods(_intervals(spark, d), ["src", "video_id"], "s", "e")
    return periods.select("src", "video_id", F.col("period_start").alias("period_start_ms"), F.col("period_end").alias("period_end_ms"))


_SWEEP_SQL = """
WITH i AS (
  SELECT 'shots' AS src, {k} AS video_id, start_s AS a, end_s AS b FROM shots
  UNION ALL SELECT 'moments', {k}, start_time, end_time FROM moments),
m AS (SELECT src, video_id, CAST(round(a * 1000) AS BIGINT) AS s, CAST(round(b * 1000) AS BIGINT) AS e FROM i WHERE isfinite(a) AND isfinite(b) AND video_id IS NOT NULL),
g AS (SELECT src, video_id, s, e, max(e) OVER (PARTITION BY src, video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m WHERE e > s)
""".format(k=VIDEO_KEY_SQL.format("video_id"))
QUERIES = {"p4_found": p4_found, "p4_periods": p4_periods}
SQL = {
    "p4_found": _SWEEP_SQL + "SELECT src, video_id, reach AS gap_start_ms, s AS gap_end_ms FROM g WHERE s > reach",
    "p4_periods": _SWEEP_SQL
    + """, n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY src, video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT src, video_id, min(s) AS period_start_ms, max(e) AS period_end_ms FROM n GROUP BY src, video_id, k""",
}
