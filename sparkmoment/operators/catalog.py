"""Catalog upkeep: upserts, merges, resume, frame deduplication, time maps, sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..skew import grouped_last, hot_keys
from ..store import materialize
from .ranking import islands


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], prefer_new: Sequence[str], keep_old: Sequence[str]) -> DataFrame:
    """Full outer merge: ``prefer_new`` columns take the new value where there is one, ``keep_old`` ones the old.

    Both sides must be unique by ``keys``; take the latest row per key first where they aren't.
    """
    a, b = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    pick = lambda c, first, second: F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c)
    return a.join(b, on, "full_outer").select(*(pick(k, "n", "o") for k in keys), *(pick(c, "n", "o") for c in prefer_new), *(pick(c, "o", "n") for c in keep_old))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in ``order``; the cut happens within each task before rows move."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def dense_ids(rows: DataFrame, order: Sequence[str], start: int = 0, out: str = "vector_id") -> DataFrame:
    """Rows numbered start, start + 1, ... in ``order`` (which must be a total one).

    Rows are range-partitioned and numbered within partitions; the partitions' sizes (one number
    each) give the offsets. No single task sees all rows.
    """
    parts = rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    parts = materialize(parts, "ordered")
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    shift = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__s"))  # one row per partition
    numbered = parts.withColumn(out, F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    return numbered.join(F.broadcast(shift), "__p").withColumn(out, F.col(out) - 1 + F.col("__s") + start).drop("__p", "__s")


def pending(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows not yet done."""
    return rows.join(done, list(keys), "left_anti")


def compare_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, n_left, n_right, state): both, left, right or mismatch, from two tables' rows per key."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    state = F.when(F.col("n_right").isNull(), "left").when(F.col("n_left").isNull(), "right").when(F.col("n_left") != F.col("n_right"), "mismatch").otherwise("both")
    return a.join(b, key, "full_outer").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"), state.alias("state"))


def frame_to_seconds(frame: Column, unit: Column, mapped: Column, fps: Column) -> Column:
    """Seconds of a frame: milliseconds / 1000, else the map's time, else frame / fps; not below 0, null where unknown."""
    plain = F.when(fps > 0, frame / fps)
    return F.greatest(F.when(unit == "ms", frame / F.lit(1000.0)).otherwise(F.coalesce(mapped, plain)), F.lit(0.0))


def seconds_to_frame(seconds: Column, fps: Column) -> Column:
    """Frame number by the nominal rate, rounded half-even; 0 where the rate is unknown or not positive."""
    return F.coalesce(F.when(fps > 0, F.bround(F.greatest(seconds, F.lit(0.0)) * fps)), F.lit(0)).cast("bigint")


def narrowest_interval(points: DataFrame, intervals: DataFrame, least: float = 1.0) -> DataFrame:
    """(point_id, shot_id): the shortest interval that contains the point; ties by the smaller id.

    An interval is filed under its length rounded up to a power of two, in cells of that size: it
    touches two of them, however long it is. A point looks in its cell of every size there is. Rows
    with a null, NaN or infinite time or bound, and inverted intervals, take no part.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("e") - F.col("s"), F.lit(least)) / least))).cast("int")
    cell = lambda c: F.floor(F.col(c) / (F.lit(least) * F.pow(F.lit(2.0), F.col("size")))).cast("bigint")
    i = intervals.filter(finite("s") & finite("e") & (F.col("s") <= F.col("e"))).withColumn("size", size)
    sizes = [r[0] for r in i.select("size").distinct().collect()]  # exponents of a double, some thousand at most
    i = i.select("video_id", "shot_id", "s", "e", "size", F.explode(F.array_distinct(F.array(cell("s"), cell("e")))).alias("cell"))
    p = points.filter(finite("t")).select("video_id", "point_id", "t", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size")).withColumn("cell", cell("t"))
    hit = p.join(i, ["video_id", "size", "cell"]).filter("s <= t and t <= e")
    return hit.groupBy("point_id").agg(F.min_by("shot_id", F.struct(F.col("e") - F.col("s"), F.col("shot_id"))).alias("shot_id"))


def frames_in_window(frames: DataFrame, video: str, centre: float, reach: float) -> DataFrame:
    """Frames of the video within ``reach`` seconds of ``centre`` (bounds included), nearest first."""
    near = F.abs(F.col("timestamp") - F.lit(centre))
    return frames.filter((F.col("video_id") == video) & F.col("timestamp").between(centre - reach, centre + reach)).withColumn("away", near).orderBy("away", "vector_id")


def dedup_frames(frames: DataFrame, seconds: float = 0.5, cosine: float = 0.98, curated: str = "btc", protect: bool = True, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Frames without near-duplicates, per video (``keys``, of strings) in time order.

    A frame is dropped if a kept one at most ``seconds`` earlier is at least ``cosine`` similar, and
    (that one is curated while curated frames are protected, or the frame itself isn't curated). Each
    decision depends on those before it, so it is a stream over a sorted video that holds only the
    kept frames of the last ``seconds``; a gap longer than that begins a new, independent session, so
    a video is split over tasks at its gaps. Frames with a null or non-finite vector are left out.
    """
    fine = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    sessions = islands(frames.filter(fine).select(*keys, "vector_id", "timestamp", "source", "vec"), [*keys], "timestamp", seconds)
    rows = sessions.withColumn("slot", F.xxhash64(*keys, "island")).repartition("slot").sortWithinPartitions("slot", *keys, "timestamp", "vector_id")

    def run(parts):
        kept: list = []
        now = None
        for pdf in parts:
            out = []
            unit = [np.asarray(x, float) / max(np.linalg.norm(np.asarray(x, float)), 1e-12) for x in pdf.vec]
            for *v, i, slot, t, src, x in zip(*(pdf[k] for k in keys), pdf.vector_id, pdf.slot, pdf.timestamp, pdf.source, unit, strict=True):
                if (slot, v) != now:
                    kept, now = [], (slot, v)
                kept = [k for k in kept if t - k[0] <= seconds]
                own = src == curated
                if not any(float(k[1] @ x) >= cosine and ((k[2] and protect) or not own) for k in kept):
                    kept.append((t, x, own))
                    out.append((*v, i))
            yield pd.DataFrame(out, columns=[*keys, "vector_id"])

    return rows.mapInPandas(run, f"{', '.join(f'{k} string' for k in keys)}, vector_id {frames.schema['vector_id'].dataType.simpleString()}")


def sample_count(duration: Column) -> Column:
    """Frames sampled of a shot: 3 under 5 s, 5 under 15 s, else 7."""
    return F.when(duration < 5, 3).when(duration < 15, 5).otherwise(7)


def sample_times(s: Column, e: Column) -> Column:
    """Evenly spaced times of a shot with both ends; its middle where it has no length."""
    n = sample_count(e - s)
    return F.when(e <= s, F.array((s + e) / 2)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: s + i * (e - s) / (n - 1)))


def uniform_times(duration: Column, fps: float) -> Column:
    """Grid of 1 / fps seconds that begins half a step in."""
    n = F.greatest(F.floor(duration * fps), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + 0.5) / fps)).otherwise(F.array().cast("array<double>"))


def local_peaks(rows: DataFrame, key: str, time: str, value: str, least: float) -> DataFrame:
    """Interior rows above ``least`` that are no lower than either neighbour in time."""
    seq = materialize(rows.withColumns({"__o": F.struct(value), "__t": -F.col(time), "__i": -F.col("vector_id")}), "sequence")
    hot = hot_keys(seq, [key])
    seq = grouped_last(seq, [key], time, ["vector_id"], "__o", "__b", hot, own=False)
    seq = grouped_last(seq, [key], "__t", ["__i"], "__o", "__a", hot, own=False)
    v = F.col(value)
    return seq.filter((v > least) & (v >= F.col(f"__b.{value}")) & (v >= F.col(f"__a.{value}"))).drop("__b", "__a", "__o", "__t", "__i")


def spaced(rows: DataFrame, keys: Sequence[str], time: str, value: str, tie: str, gap: float, most: int) -> DataFrame:
    """(keys..., times): times picked from the highest ``value`` down, each at least ``gap`` from those picked, ``most`` of them, sorted.

    Null values come last, equal ones by time and then ``tie``. A pick depends on those before it, so a
    group is a sorted stream of which only the picks are held. Rows with a null time take no part.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    order = [F.col(k).asc_nulls_first() for k in keys] + [F.col("__v").desc_nulls_last(), F.asc("__t"), F.asc("__i")]
    picked_of = rows.select(*keys, F.col(time).cast("double").alias("__t"), F.col(value).alias("__v"), F.col(tie).alias("__i")).filter("__t is not null")
    sorted_rows = picked_of.repartition(*keys).withColumn("__g", F.hash(*keys)).sortWithinPartitions("__g", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, picked = None, []
        for pdf in batches:
            if not len(pdf):
                continue
            same = pdf[[*keys]].astype(object).where(pdf[[*keys]].notna(), None)
            ids = list(same.itertuples(index=False, name=None))
            t = pdf["__t"].to_numpy()
            edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            out, at = [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if ids[lo] != now:
                    now, picked = ids[lo], []
                free = np.ones(hi - lo, bool)
                for x in picked:
                    free &= np.abs(t[lo:hi] - x) >= gap
                while len(picked) < most and free.any():
                    i = int(free.argmax())
                    picked.append(t[lo + i])
                    at.append(lo + i)
                    free &= np.abs(t[lo:hi] - t[lo + i]) >= gap
                    free[i] = False
            out = pdf.iloc[at][[*keys, "__t"]]
            yield out

    picks = sorted_rows.drop("__v", "__i", "__g").mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", `__t` double")
    return picks.groupBy(*keys).agg(F.array_sort(F.collect_list("__t")).alias("times"))  # ``most`` of them


def merge_times(base: Column, extra: Column, s: Column, e: Column, gap: float = 0.1) -> Column:
    """Both lists, clipped to s..e and sorted; times within ``gap`` of the last kept are dropped."""
    both = F.array_sort(F.filter(F.concat(base, extra), lambda t: (t >= s) & (t <= e)))
    return F.aggregate(both, F.array().cast("array<double>"), lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) > gap), F.concat(a, F.array(t))).otherwise(a))


def register(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A register (of artifacts, model versions, finished videos) after new entries: the new one of a key wins, as a whole,
    but for ``keep`` columns, which stay where the new entry has none. Both sides are unique by ``keys``."""
    others = [c for c in old.columns if c not in keys]
    a, b = old.withColumn("__o", F.lit(True)), new.withColumn("__n", F.lit(True))
    both = a.alias("o").join(b.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    value = lambda c: F.when(F.col("n.__n").isNull(), F.col(f"o.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}") if c in keep else F.col(f"n.{c}")).alias(c)
    return both.select(*(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys), *(value(c) for c in others))


def appended(old: DataFrame, new: DataFrame, order: Sequence[str], key: str = "vector_id") -> DataFrame:
    """``old`` and the rows of ``new`` (without ``key``), numbered on from the largest key in ``order``."""
    last = old.agg(F.coalesce(F.max(key), F.lit(-1))).first()[0]
    return old.unionByName(dense_ids(new, order, last + 1, key).withColumn(key, F.col(key).cast(old.schema[key].dataType)))
