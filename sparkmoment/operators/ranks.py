"""Places within groups, computed without putting a large group into one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..skew import grouped_cumsum, grouped_places, hot_keys, salted_join
from ..store import materialize


def places(df: DataFrame, keys: Sequence[str], value: Column, out: str, spread: Sequence[str], hot: list | None = None) -> DataFrame:
    """``df`` with the place of each row by descending ``value`` within ``keys``: one more than the rows that stand higher.

    Equal values share a place; null and NaN values get a null place. Values are counted before they
    are ranked, so ties cost nothing, and large groups are ranked in parts.
    """
    keys = list(keys)
    hot = hot_keys(df, keys) if hot is None else hot
    rows = df.withColumn("__v", F.when(~F.isnan(value), -value.cast("double")) + F.lit(0.0))
    counted = rows.filter("__v is not null").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    upto = grouped_cumsum(counted, keys, "__v", F.col("__c"), "__upto", hot)
    placed = upto.select(*keys, "__v", (F.col("__upto") - F.col("__c") + 1).alias(out))
    return salted_join(rows, placed, [*keys, "__v"], "left", spread, hot).drop("__v")


def values_at(df: DataFrame, keys: Sequence[str], x: str, at: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys..., n, and per name in ``at`` a value): x at a place between the group's sorted values, by the line between its neighbours.

    ``at`` gives the place, counted from 0, from the number of values n; it is held within 0 and n - 1. Nulls are left
    out. Rows are numbered, in parts where a group is hot, and two of them are picked; a group is never collected.
    """
    keys = list(keys)
    rows = materialize(df.select(*keys, F.col(x).cast("double").alias("__x")).filter("__x is not null"), "values")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    placed = salted_join(grouped_places(rows, keys, "__x", (), "__r"), sizes, keys, "inner", ["__x", "__r"])
    out = []
    for name, place in at.items():
        h = F.greatest(F.lit(0.0), F.least(place(F.col("n")).cast("double"), F.col("n") - 1.0))
        low = F.floor(h)
        a = F.max(F.when(F.col("__r") == low, F.col("__x")))
        b = F.max(F.when(F.col("__r") == low + 1, F.col("__x")))
        d = F.max(h - low)
        out.append((a + F.when(d > 0, d * (b - a)).otherwise(0.0)).alias(name))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *out)
