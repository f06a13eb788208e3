"""One ranking from several scores of different scales: first principal component of their ranks.

Every score is replaced by its rank among the items of its group, so that no scale dominates. The
scores' correlation matrix is computed in one distributed aggregation over all rows (its size depends
on the number of scores only). The first eigenvector weighs the ranks, every loading with its full
size and with the sign of its score's declared direction, so that standing higher on a score never
lowers an item. Items are sorted by the projection.

A best-by-worst-place selection is read off that order: an item whose worst place is w has a
projection of at least what w on all scores gives, so once k items of worst place at most w are
known, all others that can compete are found before that projection, and only they are compared.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.keys import VIDEO_KEY_SQL, video_key
from ..operators.ranks import places
from ..skew import FAN, hot_keys, is_hot, salted_join
from ..store import materialize
from ..tables import table


def first_component(df: DataFrame, scores: Sequence[str]) -> np.ndarray:
    """Weights of the first principal component of the columns, summing to 1.

    From the correlation matrix over all rows; a constant column correlates with none. The columns point
    in their declared directions already, so every loading is oriented to them: it counts with its size.
    Without any usable variation all weigh the same.
    """
    n = len(scores)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = df.agg(*(F.covar_pop(scores[i], scores[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = {(i, j): row[f"c{i}_{j}"] or 0.0 for i, j in pairs}
    m = np.eye(n)
    for i, j in pairs:
        scale = math.sqrt(max(cov[i, i], 0.0) * max(cov[j, j], 0.0))
        if i < j and scale > 1e-15:
            m[i, j] = m[j, i] = cov[i, j] / scale
    v = np.linalg.eigh(m)[1][:, -1]
    if not np.abs(m - np.eye(n)).max() > 0:
        return np.full(n, 1 / n)
    return np.abs(v) / np.abs(v).sum()


def rank_fusion(scores: DataFrame, group: str, item: str, name: str, value: str, directions: Mapping[str, int]) -> DataFrame:
    """Rows (group, item, n, place_<name>..., worst, projection), one per item of a group.

    ``scores`` is long: one row per group, item, score name and value. Of repeated rows the highest
    value counts (the lowest where the direction is -1). A missing, NaN or infinite value is last
    there: its place is the number of items of the group. Equal values share the better place. The
    projection weighs (place - 1) / (n - 1); small is good. Null groups and items are left out.
    """
    names = list(directions)
    sign = reduce(lambda c, x: c.when(F.col(name) == x, directions[x]), names[1:], F.when(F.col(name) == names[0], directions[names[0]]))
    v = F.col(value).cast("double")
    usable = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v * sign)
    long = scores.filter(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(name).isin(names)).groupBy(F.col(group).alias("g"), F.col(item).alias("i"), F.col(name).alias("s")).agg(F.max(usable).alias("v"))
    long = materialize(long, "scores")
    hot = hot_keys(long, ["g"])
    ranked = places(long, ["g", "s"], F.col("v"), "place", ["i"], hot)
    wide = ranked.groupBy("g", "i").agg(*(F.max(F.when(F.col("s") == x, F.col("place"))).alias(f"p{k}") for k, x in enumerate(names)))
    wide = materialize(wide, "places")
    size = wide.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    wide = salted_join(wide, size, ["g"], "inner", ["i"], hot)
    wide = wide.select("g", "i", "n", *(F.coalesce(f"p{k}", "n").alias(f"p{k}") for k in range(len(names))))
    unit = [(F.coalesce((F.col(f"p{k}") - 1) / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0))).alias(f"u{k}") for k in range(len(names))]
    weights = first_component(wide.select(*unit), [f"u{k}" for k in range(len(names))])
    worst = F.greatest(*(F.col(f"p{k}") for k in range(len(names)))) if len(names) > 1 else F.col("p0")
    projection = reduce(Column.__add__, [F.lit(float(w)) * F.coalesce((F.col(f"p{k}") - 1) / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)) for k, w in enumerate(weights)])
    return wide.select(F.col("g").alias(group), F.col("i").alias(item), "n", *(F.col(f"p{k}").cast("bigint").alias(f"place_{x}") for k, x in enumerate(names)), worst.cast("bigint").alias("worst"), projection.alias("projection"))


def best_worst(ranked: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The k items per group whose worst place is best, found in the order of the projection.

    Ties by the item. A group is first cut down in parts, so that none has to be sorted in one task.
    """
    # The k first of each part by projection hold the k first of the group; their worst places bound the rest.
    hot = hot_keys(ranked, [group])
    part = F.when(is_hot([group], hot), F.pmod(F.xxhash64(item), F.lit(FAN))).otherwise(F.lit(0))
    parted = ranked.withColumn("__part", part)
    order = [F.col("projection"), F.col(item)]
    heads = parted.withColumn("__r", F.row_number().over(W.partitionBy(group, "__part").orderBy(*order))).filter(F.col("__r") <= k)
    bound = heads.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy("worst"))).filter(F.col("__r") <= k).groupBy(group).agg(F.max("worst").alias("__w"))
    # worst <= w implies projection <= (w - 1) / (n - 1), for the weights sum to 1.
    limit = F.coalesce((F.col("__w") - 1) / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)) + F.lit(1e-9)
    rest = salted_join(parted, bound, [group], "inner", [item], hot).filter(F.col("projection") <= limit)
    order = [F.col("worst"), F.col(item)]
    rest = rest.withColumn("__r", F.row_number().over(W.partitionBy(group, "__part").orderBy(*order))).filter(F.col("__r") <= k)
    return rest.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= k).withColumn("standing", F.col("__r")).drop("__r", "__part", "__w")


DIRECTIONS = {"bm25": 1, "dense": 1, "asr": 1, "visual": 1, "object": 1}


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """The five scores of the videos found for each query, one row per score."""
    m = table(spark, d, "segment_matches").select("query_id", video_key("video_id").alias("video_id"), "bm25_score", "dense_score")
    dense = F.when(F.col("dense_score") != 0, F.col("dense_score"))  # 0.0: not computed
    m = m.select("query_id", "video_id", F.inline(F.array(F.struct(F.lit("bm25").alias("name"), F.col("bm25_score").alias("value")), F.struct(F.lit("dense").alias("name"), dense.alias("value")))))
    s = table(spark, d, "modality_signals").select("query_id", video_key("video_id").alias("video_id"), "name", F.col("raw_score").alias("value"))
    return m.unionByName(s)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion(_scores(spark, d), "query_id", "video_id", "name", "value", DIRECTIONS)


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every video found for a query with its places and its projection (small is good)."""
    return _ranked(spark, d).withColumn("projection", F.round("projection", 5))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return best_worst(_ranked(spark, d), "query_id", "video_id", 3).select("query_id", "video_id")


_PLACES_SQL = """
WITH x AS (
  SELECT query_id, {k} AS video_id, 'bm25' AS name, bm25_score AS v FROM segment_matches
  UNION ALL SELECT query_id, {k}, 'dense', CASE WHEN dense_score <> 0 THEN dense_score END FROM segment_matches
  UNION ALL SELECT query_id, {k}, name, raw_score FROM modality_signals),
b AS (SELECT query_id, video_id, name, max(CASE WHEN isfinite(v) THEN v END) AS v FROM x WHERE query_id IS NOT NULL AND video_id IS NOT NULL AND name IN ('bm25', 'dense', 'asr', 'visual', 'object') GROUP BY ALL),
p AS (SELECT *, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY query_id, name ORDER BY v DESC NULLS LAST) END AS place FROM b),
n AS (SELECT query_id, count(DISTINCT video_id) AS n FROM b GROUP BY 1),
w AS MATERIALIZED (SELECT query_id, video_id, any_value(n) AS n, {a} FROM p JOIN n USING (query_id) GROUP BY ALL)
""".format(
    k=VIDEO_KEY_SQL.format("video_id"),
    a=", ".join(f"coalesce(max(CASE WHEN name = '{x}' THEN place END), any_value(n)) AS place_{x}" for x in DIRECTIONS),
)
_WORST = "greatest({})".format(", ".join(f"place_{x}" for x in DIRECTIONS))


def _component_sql(squarings: int = 12) -> str:
    """First component in SQL: the correlation matrix is squared until only its first direction is left."""
    names = list(DIRECTIONS)
    k = range(len(names))
    unit = ", ".join(f"coalesce((place_{x} - 1) / nullif(n - 1, 0), 0.0) AS u{i}" for i, x in enumerate(names))
    c = lambda i, j: f"c{min(i, j)}_{max(i, j)}"
    upper = [(i, j) for i in k for j in k if i <= j]
    out = [f", u AS MATERIALIZED (SELECT *, {unit} FROM w)", "m0 AS MATERIALIZED (SELECT {} FROM u)".format(", ".join("1.0 AS " + c(i, j) if i == j else f"corr(u{i}, u{j}) AS {c(i, j)}" for i, j in upper))]
    for r in range(squarings):
        trace = " + ".join(c(i, i) for i in k)
        out.append("m{} AS MATERIALIZED (SELECT {} FROM (SELECT *, {} AS tr FROM m{}))".format(r + 1, ", ".join("({}) / (tr * tr) AS {}".format(" + ".join(f"{c(i, x)} * {c(x, j)}" for x in k), c(i, j)) for i, j in upper), trace, r))
    size = " + ".join(f"sqrt({c(i, i)})" for i in k)
    out.append("l AS (SELECT {} FROM m{})".format(", ".join(f"sqrt({c(i, i)}) / ({size}) AS w{i}" for i in k), squarings))
    return ",\n".join(out)


QUERIES = {"p3_found": p3_found, "p3_ranking": p3_ranking}
SQL = {
    "p3_found": _PLACES_SQL + f"SELECT query_id, video_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_WORST}, video_id) AS r FROM w) WHERE r <= 3",
    "p3_ranking": _PLACES_SQL + _component_sql() + " SELECT query_id, video_id, n, {}, {} AS worst, round({}, 5) AS projection FROM u, l".format(", ".join(f"place_{x}" for x in DIRECTIONS), _WORST, " + ".join(f"w{i} * u{i}" for i in range(len(DIRECTIONS)))),
}
