"""As-of joins: each row with the row of the same keys that is nearest in time, before, after or on either side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..skew import grouped_last, hot_keys
from ..store import materialize


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float | None = None, side: str = "nearest") -> DataFrame:
    """``left`` (keys..., t, ...) with ``id`` and ``time`` of the right row (keys..., t, id) that fits it; null where none does.

    ``side`` is before (at or before), after (at or after) or nearest; the distance is ``tolerance`` at
    most. Of equal times, and of equal distances, the smaller id is taken. Null and NaN times and null
    keys match nothing. Both tables become one sequence along which ids are handed on; a hot key's
    sequence is worked on in parts.
    """
    keys = list(keys)
    kind = right.schema["id"].dataType
    named = left.withColumn("__row", F.struct(*(F.col(c) for c in left.columns)))
    timed = F.col("t").isNotNull() & ~F.isnan(F.col("t").cast("double"))
    held = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        held = held & F.col(k).isNotNull()
    fits = named.filter(timed & held)
    other = named.filter(~F.coalesce(timed & held, F.lit(False))).select(*left.columns, F.lit(None).cast(kind).alias("id"), F.lit(None).cast("double").alias("time"))
    events = right.filter(timed & held).groupBy(*keys, F.col("t").cast("double").alias("__t")).agg(F.min("id").alias("id"))
    events = events.select(*keys, "__t", F.struct(F.col("__t").alias("time"), "id").alias("__e"), F.lit(None).cast(named.schema["__row"].dataType).alias("__row"))
    seq = fits.select(*keys, F.col("t").cast("double").alias("__t"), F.lit(None).cast(events.schema["__e"].dataType).alias("__e"), "__row").unionByName(events)
    seq = materialize(seq.withColumns({"__back": -F.col("__t"), "__kind": F.col("__e").isNull().cast("int")}), "sequence")
    hot = hot_keys(seq, keys)
    if side in ("before", "nearest"):
        seq = grouped_last(seq, keys, "__t", ["__kind"], "__e", "__b", hot)
    if side in ("after", "nearest"):
        seq = grouped_last(seq, keys, "__back", ["__kind"], "__e", "__a", hot)
    away = lambda e: F.abs(F.col(f"{e}.time") - F.col("__t"))
    if side == "nearest":
        first = F.col("__a").isNull() | (away("__b") < away("__a")) | ((away("__b") == away("__a")) & (F.col("__b.id") <= F.col("__a.id")))
        best = F.when(F.col("__b").isNotNull() & first, F.col("__b")).otherwise(F.col("__a"))
    else:
        best = F.col("__b" if side == "before" else "__a")
    found = seq.filter("__row is not null").select("__row", "__t", best.alias("__e"))
    if tolerance is not None:
        found = found.withColumn("__e", F.when(away("__e") <= tolerance, F.col("__e")))
    return found.select("__row.*", F.col("__e.id").alias("id"), F.col("__e.time").alias("time")).unionByName(other)
