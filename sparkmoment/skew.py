"""Joins and running sums that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so at most HOT_SHARE keys are hot:
#: whatever is collected or broadcast per hot key has that bound, however large the data.
HOT_SHARE = 64
#: Parts into which a hot key is split.
FAN = 32


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read from fewer parts than there are cores, as one small file is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hot_keys(df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE) -> list:
    """Rows (keys..., n) of the keys that hold more than 1/share of the rows; there are fewer than ``share`` such keys.

    Counting is pre-aggregated per input partition, so a hot key costs nothing extra. ``df`` is read
    twice: give a table or what ``materialize`` returned.
    """
    total = df.count()
    often = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") * share > total)
    return [r for r in often.collect() if all(r[k] is not None for k in keys)]


def is_hot(keys: Sequence[str], hot: list) -> Column:
    """Whether a row's keys are among ``hot``, rows or dicts with some or all of the keys."""
    out = F.lit(False)
    for r in hot:
        same = F.lit(True)
        for k in keys:
            if k in r:
                same = same & (F.col(k) == F.lit(r[k]))
        out = out | same
    return F.coalesce(out, F.lit(False))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, spread: Sequence[str], hot: list | None = None, fan: int = FAN) -> DataFrame:
    """``left.join(right, keys, how)`` in which hot keys of ``left`` are split over ``fan`` tasks.

    ``how`` is inner, left, left_semi or left_anti (every left row still meets all its partners,
    because right rows of hot keys are repeated once per part). ``spread`` are left columns whose
    hash chooses the part: deterministic, so a retried task sends its rows to the same place.
    Rows with a null key match nothing, as in any equi-join.
    """
    hot = hot_keys(left, keys) if hot is None else hot
    if not hot:
        return left.join(right, list(keys), how)
    part = F.pmod(F.xxhash64(*spread), F.lit(fan)).cast("int")
    a = left.withColumn("__salt", F.when(is_hot(keys, hot), part).otherwise(F.lit(0)))
    b = right.withColumn("__salt", F.explode(F.when(is_hot(keys, hot), F.sequence(F.lit(0), F.lit(fan - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


def _parted(df: DataFrame, keys: list[str], order: str, hot: list, fan: int) -> DataFrame:
    """``df`` with ``__part``: hot groups cut at approximate quantiles of ``order``, others whole (0); ``__cuts`` is null for those."""
    cuts = df.filter(is_hot(keys, hot)).groupBy(*keys).agg(F.percentile_approx(F.col(order).cast("double"), [i / fan for i in range(1, fan)], 1000).alias("__cuts"))
    cuts = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)  # at most HOT_SHARE rows
    return df.join(F.broadcast(cuts), keys, "left").withColumn("__part", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(order).cast("double"))), F.lit(0)))


def grouped_cumsum(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, hot: list | None = None, fan: int = FAN, peers: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Running sum of ``value`` by ``order``, a number, and then by ``ties`` within ``keys`` (without ``ties``, rows with equal ``order`` may take any order).

    Hot groups are cut at approximate quantiles of ``order``; each part is summed in its own task
    and shifted by the total of the parts before it, so no group has to fit into one task. With
    ``peers`` rows of equal ``order`` all get the sum that includes them all.
    """
    keys = list(keys)
    hot = hot_keys(df, keys) if hot is None else hot
    frame = (lambda w: w.rangeBetween(W.unboundedPreceding, W.currentRow)) if peers else (lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow))
    running = lambda w: F.sum(value).over(frame(w.orderBy(order, *ties)))
    if not hot:
        return df.withColumn(out, running(W.partitionBy(*keys)))
    parted = _parted(df, keys, order, hot, fan)
    totals = parted.filter(F.col("__cuts").isNotNull()).groupBy(*keys, "__part").agg(F.sum(value).alias("__total"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select(*keys, "__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__shift"))
    return (
        parted.join(F.broadcast(shift), [*keys, "__part"], "left")  # at most HOT_SHARE * FAN rows
        .withColumn(out, running(W.partitionBy(*keys, "__part")) + F.coalesce("__shift", F.lit(0)))
        .drop("__cuts", "__part", "__shift")
    )


def grouped_last(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], value: str, out: str, hot: list | None = None, fan: int = FAN, own: bool = True) -> DataFrame:
    """``df`` with the last ``value`` that isn't null in the rows up to this one (``own``), or before it, by ``order`` (a number) and ``ties``.

    Hot groups are worked on in parts; what a part ends with is handed on to the parts after it.
    """
    keys = list(keys)
    hot = hot_keys(df, keys) if hot is None else hot
    running = lambda w: F.last(value, ignorenulls=True).over(w.orderBy(order, *ties).rowsBetween(W.unboundedPreceding, W.currentRow if own else -1))
    if not hot:
        return df.withColumn(out, running(W.partitionBy(*keys)))
    parted = _parted(df, keys, order, hot, fan)
    ends = parted.filter(F.col("__cuts").isNotNull() & F.col(value).isNotNull()).groupBy(*keys, "__part").agg(F.max_by(value, F.struct(order, *ties)).alias("__end"))
    every = parted.filter(F.col("__cuts").isNotNull()).select(*keys, "__part").distinct().join(ends, [*keys, "__part"], "left")
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    handed = every.select(*keys, "__part", F.last("__end", ignorenulls=True).over(before).alias("__last"))
    joined = parted.join(F.broadcast(handed), [*keys, "__part"], "left")  # at most HOT_SHARE * FAN rows
    return joined.withColumn(out, F.coalesce(running(W.partitionBy(*keys, "__part")), "__last")).drop("__cuts", "__part", "__last")


def grouped_previous(df: DataFrame, keys: Sequence[str], order: str, out: str, hot: list | None = None, fan: int = FAN) -> DataFrame:
    """``df`` with the value of ``order`` in the row before (null in a group's first row), hot groups worked on in parts."""
    return grouped_last(df, keys, order, (), order, out, hot, fan, own=False)


def grouped_places(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], out: str, hot: list | None = None, fan: int = FAN) -> DataFrame:
    """``df`` with ``out``, 0, 1, ... by ``order`` (a number) and ``ties`` within ``keys``; hot groups are numbered in parts."""
    return grouped_cumsum(df, keys, order, F.lit(1), out, hot, fan, ties=ties).withColumn(out, F.col(out) - 1)
