"""Records paired with the nearest record in time of the same entity, by a streaming merge.

Both tables are cut by entity and stretch of time and sorted by (entity, time) within partitions;
one iterator passes over each partition and keeps only the neighbouring right records of the place
it has reached. Right records within the tolerance of a stretch's border are sent to both sides of
it, so a stretch can be merged without its neighbours and an entity with a large share of the rows is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import VIDEO_KEY_SQL, millis, video_key
from ..skew import FAN, hot_keys, is_hot
from ..tables import table

TOLERANCE_MS = 2000
#: Length of a stretch of time, in tolerances.
STRETCH = 300


def _merge(tolerance: int):
    """Function over batches (slot, slot2, t, left_no, right_no) sorted by slot, slot2, t, where a record has
    one of the two numbers. Yields (left_no, right_no, distance) of the left records that have a partner.

    Between batches it keeps the right record passed last and the left records not more than the
    tolerance behind the place reached, no nearer to the one passed than to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The right record passed last, and left records that may still meet a nearer one.
        last = None
        wait = None
        for b in batches:
            if not b.num_rows:
                continue
            slot = np.asarray(b.column(0)) ^ (np.asarray(b.column(1)).astype(np.int64) * 0x5851F42D4C957F2D)
            t = np.asarray(b.column(2))
            is_right = ~np.asarray(b.column(3).is_valid())  # no left number
            left = np.asarray(b.column(3).fill_null(0))
            right = np.asarray(b.column(4).fill_null(0))
            # In the order of the stream: the right record, then those that wait, then the batch.
            for held in (wait, last):
                if held is not None:
                    slot, t, is_right, left, right = (np.concatenate([x, y]) for x, y in zip(held, (slot, t, is_right, left, right), strict=True))
            n = len(t)
            idx = np.arange(n)
            before = np.maximum.accumulate(np.where(is_right, idx, -1))
            after = np.minimum.accumulate(np.where(is_right, idx, n)[::-1])[::-1]
            mine = np.flatnonzero(~is_right)
            p, q = before[mine], after[mine]
            big = np.iinfo(np.int64).max
            dp = np.where((p >= 0) & (slot[np.maximum(p, 0)] == slot[mine]), t[mine] - t[np.maximum(p, 0)], big)
            q_in = np.minimum(q, n - 1)
            dq = np.where((q < n) & (slot[q_in] == slot[mine]), t[q_in] - t[mine], big)
            # Not decided: no right record after it yet, in the slot the batch ends in, and one could still be near enough.
            open_ = (q == n) & (slot[mine] == slot[-1]) & (t[-1] - t[mine] <= tolerance) & (t[-1] - t[mine] <= dp)
            rp, rq = right[np.maximum(p, 0)], right[q_in]
            use_q = (dq < dp) | ((dq == dp) & (rq < rp))
            best, d = np.where(use_q, rq, rp), np.minimum(dp, dq)
            good = ~open_ & (d <= tolerance)
            yield pa.RecordBatch.from_arrays([pa.array(left[mine[good]]), pa.array(best[good]), pa.array(d[good])], names=["left_no", "right_no", "distance"])
            r = before[-1]
            last = None if r < 0 else tuple(x[r : r + 1] for x in (slot, t, is_right, left, right))
            w = mine[open_]
            wait = tuple(x[w] for x in (slot, t, is_right, left, right)) if len(w) else None
        if wait is not None:
            slot, t, _, left, _ = wait
            if last is not None:
                d = np.where(slot == last[0][0], t - last[1][0], np.iinfo(np.int64).max)
                good = d <= tolerance
                yield pa.RecordBatch.from_arrays([pa.array(left[good]), pa.array(np.full(int(good.sum()), last[4][0], np.int64)), pa.array(d[good].astype(np.int64))], names=["left_no", "right_no", "distance"])

    return run


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int = TOLERANCE_MS, stretch: int = STRETCH) -> DataFrame:
    """Nearest right record of each left record.

    ``left`` has (entity, t, left_no, ...), ``right`` (entity, t, right_no), times and numbers BIGINT;
    left_no need be unique per entity, time and partition source only. Returns (left_no, right_no, distance) where
    distance <= tolerance; of equally near records the one with the smaller right_no. Null entities
    and null times take no part; right records repeated at one time count once.
    """
    width = max(tolerance, 1) * stretch
    stretch_of = lambda t: F.floor(t / F.lit(float(width))).cast("bigint")
    lefts = left.filter("entity is not null and t is not null").select("entity", stretch_of(F.col("t")).alias("part"), "t", "left_no", F.lit(None).cast("bigint").alias("right_no"))
    hot = hot_keys(lefts, ["entity", "part"])  # stretches in which very many left records fall are split further
    lefts = lefts.withColumn("share", F.when(is_hot(["entity", "part"], hot), F.pmod(F.xxhash64("left_no"), F.lit(FAN))).otherwise(F.lit(0)).cast("int"))
    r = right.filter("entity is not null and t is not null and right_no is not null").groupBy("entity", "t").agg(F.min("right_no").alias("right_no"))
    near = F.array_distinct(F.array(stretch_of(F.col("t") - tolerance), stretch_of(F.col("t")), stretch_of(F.col("t") + tolerance)))
    r = r.select("entity", F.explode(near).alias("part"), "t", F.lit(None).cast("bigint").alias("left_no"), "right_no")
    shares = F.when(is_hot(["entity", "part"], hot), F.sequence(F.lit(0), F.lit(FAN - 1))).otherwise(F.array(F.lit(0)))
    both = lefts.unionByName(r.withColumn("share", F.explode(shares)))
    # A slot is one stretch of one entity, named by 96 bits.
    both = both.select(F.xxhash64("entity", "part", "share").alias("slot"), F.hash("entity", "part", "share").alias("slot2"), "t", "left_no", "right_no")
    both = both.repartition("slot").sortWithinPartitions("slot", "slot2", "t")
    return both.mapInArrow(_merge(tolerance), "left_no bigint, right_no bigint, distance bigint")


def _times(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Left records numbered 2k for transcript matches and 2k + 1 for frame requests, and the frames."""
    one = lambda t, i, c, k: table(spark, d, t).select(video_key("video_id").alias("entity"), millis(c).alias("t"), (F.col(i) * 2 + k).alias("left_no"))
    lefts = one("segment_matches", "match_id", "start", 0).unionByName(one("frame_requests", "request_id", "requested_timestamp", 1))
    frames = table(spark, d, "frames").select(video_key("video_id").alias("entity"), millis("timestamp").alias("t"), F.col("vector_id").alias("right_no"))
    return lefts, frames


def p7_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Source, record, nearest frame and its distance in ms."""
    found = nearest_in_time(*_times(spark, d))
    src = F.when(F.pmod("left_no", F.lit(2)) == 0, "segment_matches").otherwise("frame_requests")
    return found.select(src.alias("src"), F.shiftright("left_no", 1).alias("src_id"), F.col("right_no").alias("vector_id"), F.col("distance").alias("distance_ms"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_nearest(spark, d).select("src", "src_id", "vector_id")


_SQL = """
WITH f AS (SELECT {k} AS v, CAST(round("timestamp" * 1000) AS BIGINT) AS t, min(vector_id) AS vector_id FROM frames WHERE isfinite("timestamp") AND video_id IS NOT NULL GROUP BY 1, 2),
q AS (
  SELECT 'segment_matches' AS src, match_id AS src_id, {k} AS v, CAST(round("start" * 1000) AS BIGINT) AS t FROM segment_matches WHERE isfinite("start")
  UNION ALL SELECT 'frame_requests', request_id, {k}, CAST(round(requested_timestamp * 1000) AS BIGINT) FROM frame_requests WHERE isfinite(requested_timestamp)),
n AS (SELECT src, src_id, vector_id, abs(f.t - q.t) AS distance_ms FROM q JOIN f ON f.v = q.v AND f.t BETWEEN q.t - 2000 AND q.t + 2000),
b AS (SELECT *, row_number() OVER (PARTITION BY src, src_id ORDER BY distance_ms, vector_id) AS rn FROM n)
SELECT src, src_id, vector_id{x} FROM b WHERE rn = 1
"""
_KEY = VIDEO_KEY_SQL.format("video_id")
QUERIES = {"p7_found": p7_found, "p7_nearest": p7_nearest}
SQL = {"p7_found": _SQL.format(k=_KEY, x=""), "p7_nearest": _SQL.format(k=_KEY, x=", distance_ms")}
