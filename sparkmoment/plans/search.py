"""Queries of vector search, fusion, normalisation and grouping over ``embeddings`` and ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.keys import VIDEO_KEY_SQL, video_key
from ..functions.vectors import cosine, dot, normalize
from ..operators import annindex as I, ranking as R, vector as V
from ..store import materialize, shared_dir
from ..tables import table


def frames(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("vector_id"), F.concat(F.lit("V"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("video_id"), F.col("vec_id").alias("frame_id"), F.col("embedding").alias("vec"))


def events_of(s: SparkSession, d: str) -> DataFrame:
    """The three events of one search, as vectors 0, 1 and 2."""
    return table(s, d, "embeddings").filter(F.col("vec_id").isin(0, 1, 2)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


def every_20th(s: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 as a query."""
    return table(s, d, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


def candidates(s: SparkSession, d: str) -> DataFrame:
    """Events as scored candidates: user as video, seconds as time, type as label."""
    return table(s, d, "events").select(
        F.col("event_id").alias("vector_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("video_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        F.col("value").alias("score"),
        F.col("event_type").alias("label"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


_FR = """WITH fr AS (SELECT vec_id AS vector_id, 'V' || lpad(CAST(label AS VARCHAR), 2, '0') AS video_id, vec_id AS frame_id, CAST(embedding AS DOUBLE[]) AS v0 FROM embeddings),
f AS (SELECT *, list_transform(v0, lambda x: x / greatest(sqrt(list_dot_product(v0, v0)), 1e-12)) AS vec FROM fr)
"""
_CA = """WITH c AS (SELECT event_id AS vector_id, 'U' || user_id AS video_id, epoch_us(ts) / 1e6 AS timestamp, value AS score, event_type AS label, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
"""
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT count(*) AS n_rows, CAST(min(len(embedding)) AS BIGINT) AS min_dim, CAST(max(len(embedding)) AS BIGINT) AS max_dim,
CAST(sum(CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_not_finite,
CAST(sum(CASE WHEN abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS n_not_unit FROM embeddings""")
def vector_normalize_check(s, d):
    return V.vector_checks(frames(s, d))


_MEAN = _FR + """, u AS (SELECT video_id, pos, avg(v0[pos]) AS x FROM fr, range(1, 65) r(pos) GROUP BY ALL),
n AS (SELECT video_id, sqrt(sum(x * x)) AS n FROM u GROUP BY 1), m AS (SELECT video_id, pos, x / greatest(n, 1e-12) AS x FROM u JOIN n USING (video_id))
"""


@query(_MEAN + "SELECT video_id, CAST(pos - 1 AS BIGINT) AS pos, round(x, 6) AS x FROM m")
def video_mean_pool(s, d):
    pooled = V.mean_pool(frames(s, d), ["video_id"])
    return pooled.select("video_id", F.posexplode("vec").alias("pos", "x")).select("video_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query(_CA + "SELECT vector_id, label, round(CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm FROM c WINDOW w AS (PARTITION BY label)")
def normalize_minmax(s, d):
    return R.by_extent(candidates(s, d), ["label"], "score", "norm").select("vector_id", "label", F.round("norm", 6).alias("norm"))


@query(_CA + "SELECT vector_id, label, round(CASE WHEN max(score) OVER w < 1e-9 THEN 0.0 ELSE score / max(score) OVER w END, 6) AS norm FROM c WINDOW w AS (PARTITION BY label)")
def normalize_maxdiv(s, d):
    return R.by_highest(candidates(s, d), ["label"], "score", "norm").select("vector_id", "label", F.round("norm", 6).alias("norm"))


@query(_CA + "SELECT vector_id, label, round(1 / (1 + exp(-score / 100)), 6) AS norm FROM c")
def normalize_sigmoid(s, d):
    return candidates(s, d).select("vector_id", "label", F.round(R.sigmoid(F.col("score"), 100.0), 6).alias("norm"))


@query(_CA + ", p AS (SELECT label, quantile_cont(score, 0.9) AS p, count(score) AS n FROM c GROUP BY 1) SELECT vector_id, label, round(CASE WHEN n < 2 OR abs(p) < 1e-9 THEN 1.0 ELSE greatest(0.0, least(1.0, score / p)) END, 6) AS norm FROM c JOIN p USING (label)")
def normalize_percentile90(s, d):
    return R.by_percentile(candidates(s, d), ["label"], "score", "norm").select("vector_id", "label", F.round("norm", 6).alias("norm"))


@query(_CA + """, m AS (SELECT 'semantic' AS modality, 0.7 AS w, vector_id AS id, score FROM c UNION ALL SELECT 'ocr', 0.3, vector_id, k FROM c WHERE k IS NOT NULL),
z AS (SELECT id, w, CASE WHEN max(score) OVER p - min(score) OVER p < 1e-9 THEN 1.0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS s FROM m WINDOW p AS (PARTITION BY modality))
SELECT id, round(sum(w * s) / 1.0, 6) AS score FROM z GROUP BY 1""")
def modality_fusion(s, d):
    c = candidates(s, d)
    long = c.select(F.lit("semantic").alias("modality"), F.col("vector_id").alias("id"), "score").unionByName(c.filter("k is not null").select(F.lit("ocr").alias("modality"), F.col("vector_id").alias("id"), F.col("k").alias("score")))
    return R.modality_fusion(long, {"semantic": 0.7, "ocr": 0.3, "asr": 0.0}).select("id", F.round("score", 6).alias("score"))


@query(_CA + """, x AS (SELECT *, CASE WHEN label IN ('error', 'click') THEN 1.0 ELSE 0.0 END AS coverage FROM c),
y AS (SELECT vector_id, video_id, score, coverage, count(*) OVER (PARTITION BY video_id) AS n, avg(coverage) OVER (PARTITION BY video_id) AS cv, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, vector_id) - 1 AS r FROM x)
SELECT vector_id, video_id, round(CASE WHEN n = 1 THEN score ELSE (CASE WHEN cv < 0.05 THEN 0.8 ELSE 0.65 END) * (1 - r / (n - 1)) + (1 - CASE WHEN cv < 0.05 THEN 0.8 ELSE 0.65 END) * coverage END, 6) AS fused FROM y""")
def adaptive_rank_fusion(s, d):
    c = candidates(s, d).withColumn("coverage", F.when(F.col("label").isin("error", "click"), 1.0).otherwise(0.0))
    return R.adaptive_rank_fusion(c, "video_id").select("vector_id", "video_id", F.round("fused", 6).alias("fused"))


_IS = _CA + """, g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w > {gap} THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY video_id ORDER BY timestamp, vector_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY timestamp, vector_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
"""


@query(_IS.format(gap=3600) + "SELECT vector_id, video_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY video_id, island ORDER BY score DESC, timestamp, vector_id) AS r FROM i) WHERE r = 1")
def dedupe_temporal(s, d):
    return R.dedupe_temporal(candidates(s, d), 3600.0).select("vector_id", "video_id", F.round("score", 6).alias("score"))


@query(_IS.format(gap=3600) + "SELECT video_id, CAST(island AS BIGINT) AS island, count(*) AS n, round(max(score), 6) AS score, round(max(timestamp) - min(timestamp), 6) AS seconds FROM i GROUP BY 1, 2")
def moments_gap(s, d):
    m = R.moments(candidates(s, d), 3600.0)
    return m.select("video_id", F.col("island").cast("bigint").alias("island"), "n", F.round("score", 6).alias("score"), F.round(F.col("end") - F.col("start"), 6).alias("seconds"))


@query(_IS.format(gap=3600) + "SELECT video_id, CAST(island AS BIGINT) AS island, round(ln(sum(exp(score / 100))), 6) AS score FROM i GROUP BY 1, 2")
def moments_lse(s, d):
    m = R.moments(candidates(s, d).withColumn("score", F.col("score") / 100), 3600.0, "lse")
    return m.select("video_id", F.col("island").cast("bigint").alias("island"), F.round("score", 6).alias("score"))


_SH = """WITH c AS (SELECT vector_id, {k} AS video_id, "timestamp" AS t, shot_id FROM frames WHERE isfinite("timestamp") AND video_id IS NOT NULL),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 3 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY video_id ORDER BY t, vector_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY t, vector_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
z AS (SELECT video_id, island, arg_min({{'s': shot_id}}, {{'t': t, 'v': vector_id}}).s AS shot, min(t) AS a, max(t) AS b, count(*) AS n FROM i GROUP BY 1, 2),
y AS (SELECT *, CASE WHEN lag(shot) OVER w = shot THEN 0 ELSE 1 END AS new FROM z WINDOW w AS (PARTITION BY video_id ORDER BY island)),
m AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY island ROWS UNBOUNDED PRECEDING) - 1 AS moment FROM y)
""".format(k=VIDEO_KEY_SQL.format("video_id"))


@query(_SH + "SELECT video_id, CAST(moment AS BIGINT) AS moment, CAST(sum(n) AS BIGINT) AS n, round(max(b) - min(a), 6) AS seconds FROM m GROUP BY 1, 2")
def moments_shot(s, d):
    """Sessions of each video's frames that a shared shot keeps together."""
    c = table(s, d, "frames").select("vector_id", video_key("video_id").alias("video_id"), "timestamp", "shot_id", F.lit(0.0).alias("score"))
    m = R.moments_with_shots(c.filter(F.col("video_id").isNotNull() & (F.abs("timestamp") < float("inf"))), 3.0)
    return m.select("video_id", F.col("moment").cast("bigint").alias("moment"), F.col("n").cast("bigint").alias("n"), F.round(F.col("end") - F.col("start"), 6).alias("seconds"))


@query(_IS.format(gap=3600) + ", m AS (SELECT video_id, island, max(score) AS score, arg_max(vector_id, {'s': score, 't': -timestamp, 'v': -vector_id}) AS vector_id, min(timestamp) AS start FROM i GROUP BY 1, 2) SELECT video_id, vector_id, round(score, 6) AS score FROM m ORDER BY score DESC, vector_id LIMIT 100")
def moments_to_frames(s, d):
    """One frame per moment, scored as the moment."""
    m = R.moments(candidates(s, d), 3600.0).select("video_id", F.col("best").alias("vector_id"), F.round("score", 6).alias("score"))
    return m.orderBy(F.desc("score"), "vector_id").limit(100)


_TILED = _FR + """, p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM fr),
t AS (SELECT video_id, seg, vector_id, v0 FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((n - 10) / {step}.0)) AS BIGINT) + 1)) AS seg FROM p) WHERE pos >= seg * {step} AND pos < seg * {step} + 10)
"""
_TILE = _TILED + """, a AS (SELECT video_id, seg, pos, {agg}(v0[pos]) AS x FROM t, range(1, 65) r(pos) GROUP BY ALL), z AS (SELECT video_id, seg, sqrt(sum(x * x)) AS n FROM a GROUP BY ALL)
SELECT video_id, seg, CAST(pos - 1 AS BIGINT) AS pos, round(x / n, 6) AS x FROM a JOIN z USING (video_id, seg)"""


def _flat(pooled: DataFrame) -> DataFrame:
    return pooled.select("video_id", F.col("seg").cast("bigint").alias("seg"), F.posexplode("vec").alias("pos", "x")).select("video_id", "seg", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query(_TILE.format(step=10, agg="avg"))
def segments_tile_mean(s, d):
    return _flat(V.mean_pool(V.tiles(frames(s, d), 10), ["video_id", "seg"]))


@query(_TILE.format(step=8, agg="max"))
def segments_overlap_max(s, d):
    return _flat(V.max_pool(V.tiles(frames(s, d), 10, 2), ["video_id", "seg"]))


#: Distance of each vector to its tile's mean, and the vectors' weights.
_NEAR = _TILED.format(step=10) + """, mu AS (SELECT video_id, seg, pos, avg(v0[pos]) AS m FROM t, range(1, 65) r(pos) GROUP BY ALL),
dd AS (SELECT t.video_id, t.seg, vector_id, sqrt(sum((v0[pos] - m) * (v0[pos] - m))) AS d FROM t JOIN mu USING (video_id, seg) GROUP BY ALL),
w AS ({w}),
a AS (SELECT video_id, seg, pos, sum(v0[pos] * w) / sum(w) AS x FROM t JOIN w USING (video_id, seg, vector_id), range(1, 65) r(pos) GROUP BY ALL), z AS (SELECT video_id, seg, sqrt(sum(x * x)) AS n FROM a GROUP BY ALL)
SELECT video_id, seg, CAST(pos - 1 AS BIGINT) AS pos, round(x / n, 6) AS x FROM a JOIN z USING (video_id, seg)"""


@query(_NEAR.replace("{w}", "SELECT video_id, seg, vector_id, 1.0 AS w FROM (SELECT *, row_number() OVER (PARTITION BY video_id, seg ORDER BY d, vector_id) AS r, count(*) OVER (PARTITION BY video_id, seg) AS n FROM dd) WHERE r <= greatest(1, round_even(n * 0.5, 0))"))
def segments_topk_pool(s, d):
    return _flat(V.near_mean_pool(V.tiles(frames(s, d), 10), ["video_id", "seg"], 0.5))


@query(_NEAR.replace("{w}", "SELECT video_id, seg, vector_id, 1 / greatest(d, 1e-6) AS w FROM dd"))
def segments_weighted_pool(s, d):
    return _flat(V.near_mean_pool(V.tiles(frames(s, d), 10), ["video_id", "seg"], None))





# --- every row whose id is divisible by 20 as a search of all rows ---------------------------------
# The variants (or events, or facets) of search q are the vectors q, q + 1 and q + 2.
_EV = """WITH fr AS (SELECT vec_id AS vector_id, 'V' || lpad(CAST(label AS VARCHAR), 2, '0') AS video_id, CAST(embedding AS DOUBLE[]) AS v0 FROM embeddings),
f AS (SELECT vector_id, video_id, list_transform(v0, lambda x: x / greatest(sqrt(list_dot_product(v0, v0)), 1e-12)) AS vec FROM fr),
vr AS (SELECT vector_id - vector_id % 20 AS query_id, vector_id % 20 AS v, vec FROM f WHERE vector_id % 20 < 3),
hit AS (SELECT query_id, v, f.vector_id, f.video_id, list_dot_product(f.vec, vr.vec) AS score FROM f, vr),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vector_id) AS rank FROM hit),
t100 AS (SELECT * FROM rk WHERE v = 0 AND rank <= 100),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, vector_id) AS r FROM t100)
"""


def _score():
    return F.round("score", 6).alias("score")


def variants(s: SparkSession, d: str, n: int = 3) -> DataFrame:
    """(query_id, search, v, qvec): the first n variants of every search."""
    v = F.col("vec_id") % 20
    return table(s, d, "embeddings").filter(v < n).select(F.col("vec_id").alias("query_id"), (F.col("vec_id") - v).alias("search"), v.alias("v"), F.col("embedding").alias("qvec"))


def _variant_hits(s, d, n: int, k: int) -> DataFrame:
    hits = V.knn(frames(s, d), variants(s, d, n), k)
    v = F.col("query_id") % 20
    return hits.select((F.col("query_id") - v).alias("query_id"), v.alias("v"), "vector_id", "video_id", "score", "rank")


def _every(s, d, k: int = 100) -> DataFrame:
    return V.knn(frames(s, d), every_20th(s, d), k)


@query(_EV + "SELECT query_id, vector_id, video_id, round(score, 6) AS score, rank FROM t100")
def knn_every(s, d):
    return _every(s, d).select("query_id", "vector_id", "video_id", _score(), F.col("rank").cast("bigint").alias("rank"))


@query(_EV + "SELECT query_id, vector_id, video_id, round(score, 6) AS score FROM hit WHERE v = 0 AND video_id IN ('V01', 'V03', 'V05') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) <= 50")
def knn_videos_every(s, d):
    some = frames(s, d).filter(F.col("video_id").isin("V01", "V03", "V05"))
    return V.knn(some, every_20th(s, d), 50).select("query_id", "vector_id", "video_id", _score())


@query(_EV + "SELECT query_id, vector_id, round(score, 6) AS score FROM hit WHERE v = 0 AND vector_id IN (SELECT vector_id FROM frames WHERE ocr_done) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) <= 50")
def knn_rows_every(s, d):
    """Search within the rows that another table allows: frames whose text was read."""
    rows = table(s, d, "frames").filter("ocr_done").select("vector_id")
    return V.knn(frames(s, d).join(rows, "vector_id", "left_semi"), every_20th(s, d), 50).select("query_id", "vector_id", _score())


@query(_EV + "SELECT query_id, vector_id, video_id, round(score, 6) AS score FROM d WHERE r <= 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) <= 20")
def diversify_every(s, d):
    return R.diversify(_every(s, d), 3, 20, ["query_id"]).select("query_id", "vector_id", "video_id", _score())


@query(_EV + "SELECT query_id, video_id, vector_id, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, vector_id) AS r, round(score, 6) AS score FROM hit WHERE v = 0 QUALIFY r <= 5")
def per_video_every(s, d):
    hits = V.scored(frames(s, d), every_20th(s, d)).select("query_id", "video_id", "vector_id", "score")
    return R.top_per_group(hits, ["query_id", "video_id"], 5).select("query_id", "video_id", "vector_id", F.col("rank").cast("bigint").alias("r"), _score())


@query(_EV + """, m AS (SELECT *, max(score) OVER (PARTITION BY query_id, video_id) AS m FROM d WHERE r <= 3), l AS (SELECT query_id, video_id, max(score) + ln(sum(exp(score - m))) AS vs FROM m GROUP BY 1, 2),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vs DESC, video_id) <= 5)
SELECT query_id, video_id, vector_id, r, round(vs, 6) AS video_score, round(vs - (r - 1) * 1e-4, 6) AS score FROM d JOIN b USING (query_id, video_id) WHERE r <= 4""")
def video_rerank_every(s, d):
    out = R.video_rerank(_every(s, d), 5, 4, 3, ["query_id"])
    return out.select("query_id", "video_id", "vector_id", F.col("r").cast("bigint").alias("r"), F.round("video_score", 6).alias("video_score"), _score())


@query(_EV + "SELECT query_id, vector_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM rk WHERE v < 2 AND rank <= 100 GROUP BY 1, 2")
def rrf_two_every(s, d):
    lists = _variant_hits(s, d, 2, 100).withColumnRenamed("vector_id", "id").withColumn("weight", F.lit(1.0))
    return R.rrf(lists, by=["query_id"]).select("query_id", F.col("id").alias("vector_id"), F.round("score", 9).alias("score"))


@query(_EV + "SELECT query_id, vector_id, round(sum(CASE v WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.65 END / (4 + rank)), 9) AS score FROM rk WHERE rank <= 100 GROUP BY 1, 2")
def rrf_variants_every(s, d):
    weight = F.when(F.col("v") == 0, 1.0).when(F.col("v") == 1, 0.8).otherwise(0.65)
    lists = _variant_hits(s, d, 3, 100).withColumnRenamed("vector_id", "id").withColumn("weight", weight)
    return R.rrf(lists, None, 100, ["query_id"]).select("query_id", F.col("id").alias("vector_id"), F.round("score", 9).alias("score"))


@query(_EV + "SELECT query_id, video_id, vector_id, round(score, 9) AS score FROM rk WHERE rank <= 50 QUALIFY row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(score, 9) DESC, vector_id) = 1")
def best_per_video_every(s, d):
    hits = _variant_hits(s, d, 3, 50).withColumn("score", F.round("score", 9))  # a vector's likeness to itself differs in the last bit
    return R.best_per(hits, ["query_id", "video_id"]).select("query_id", "video_id", "vector_id", "score")


def _pool(s, d) -> DataFrame:
    """The best 100 of every search, each beside its similarity ``score`` to every variant ``v``."""
    top = _every(s, d).select(F.col("query_id").alias("search"), "vector_id", F.col("score").alias("first"))
    pool = frames(s, d).select("vector_id", "vec").join(top, "vector_id").join(variants(s, d).drop("query_id"), "search")
    return pool.select(F.col("search").alias("query_id"), "vector_id", "first", "v", cosine(F.col("vec"), F.col("qvec")).alias("score"))


@query(_EV + """, c AS (SELECT query_id, vector_id, sum(score * w) / sum(w) AS cov FROM (SELECT *, CASE v WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 2.0 END AS w FROM hit) GROUP BY 1, 2),
b AS (SELECT query_id, vector_id, score, cov FROM t100 JOIN c USING (query_id, vector_id)),
x AS (SELECT *, min(score) OVER w AS s0, max(score) OVER w AS s1, min(cov) OVER w AS c0, max(cov) OVER w AS c1 FROM b WINDOW w AS (PARTITION BY query_id)),
n AS (SELECT query_id, vector_id, CASE WHEN s1 - s0 < 1e-9 THEN 0.5 ELSE (score - s0) / (s1 - s0) END AS ns, CASE WHEN c1 - c0 < 1e-9 THEN 0.5 ELSE (cov - c0) / (c1 - c0) END AS nc FROM x)
SELECT query_id, vector_id, round(nc, 6) AS coverage, round(0.5 * ns + 0.5 * nc, 6) AS score FROM n""")
def event_blend_every(s, d):
    weights = F.when(F.col("v") == 0, 1.0).when(F.col("v") == 1, 0.5).otherwise(2.0)
    cov = _pool(s, d).groupBy("query_id", "vector_id", "first").agg((F.sum(F.col("score") * weights) / F.sum(weights)).alias("cov"))
    one = W.partitionBy("query_id")
    n = cov.select("query_id", "vector_id", R.minmax(F.col("first"), one, 0.5).alias("ns"), R.minmax(F.col("cov"), one, 0.5).alias("nc"))
    return n.select("query_id", "vector_id", F.round("nc", 6).alias("coverage"), F.round(0.5 * F.col("ns") + 0.5 * F.col("nc"), 6).alias("score"))


@query(_EV + """, m AS (SELECT query_id, vector_id, max(score * CASE v WHEN 0 THEN 1.0 WHEN 1 THEN 1.2 ELSE 1.4 END) AS ms FROM hit GROUP BY 1, 2)
SELECT query_id, vector_id, round(score + 0.4 * ms, 6) AS score FROM t100 JOIN m USING (query_id, vector_id)""")
def maxsim_every(s, d):
    weights = F.when(F.col("v") == 0, 1.0).when(F.col("v") == 1, 1.2).otherwise(1.4)
    best = _pool(s, d).groupBy("query_id", "vector_id", "first").agg(F.max(F.col("score") * weights).alias("ms"))
    return best.select("query_id", "vector_id", F.round(F.col("first") + 0.4 * F.col("ms"), 6).alias("score"))


@query(_EV + """, u AS (SELECT query_id, pos, avg(vec[pos]) AS y FROM vr, range(1, 65) r(pos) GROUP BY ALL), un AS (SELECT query_id, sqrt(sum(y * y)) AS n FROM u GROUP BY 1),
mv AS (SELECT video_id, pos, avg(v0[pos]) AS x FROM fr, range(1, 65) r(pos) GROUP BY ALL), mn AS (SELECT video_id, sqrt(sum(x * x)) AS n FROM mv GROUP BY 1)
SELECT query_id, video_id, round(sum(x * y) / any_value(un.n) / any_value(mn.n), 6) AS score FROM mv JOIN mn USING (video_id) JOIN u USING (pos) JOIN un USING (query_id) GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(x * y) / any_value(un.n) / any_value(mn.n), 6) DESC, video_id) <= 5""")
def coarse_video_topk(s, d):
    """Stage one of event search: for every search, videos by the cosine of their mean vector to the events' centroid."""
    centre = V.mean_pool(variants(s, d).select("search", normalize(F.col("qvec")).alias("vec")), ["search"]).select(F.col("search").alias("query_id"), F.col("vec").alias("qvec"))
    pooled = V.mean_pool(frames(s, d), ["video_id"]).withColumn("vector_id", F.xxhash64("video_id"))
    hit = V.scored(pooled, centre).select("query_id", "video_id", F.round("score", 6).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "video_id")
    return hit.withColumn("r", F.row_number().over(w)).filter("r <= 5").drop("r")


def _ann(s, d, recall: float = 0.92):
    """The index of all vectors, written by cell, and the answers for every 20th of them."""
    f, q = frames(s, d), every_20th(s, d)
    index = I.fit(f)
    path = f"{shared_dir(s)}/tables/ann-{uuid.uuid4().hex}"
    I.write(I.file(f, index), path)
    filed = I.read(s, path)
    return I.search(filed, index, q, 20, I.probes_for(filed, index, q, 20, recall), 16)


@query()
def ann_every(s, d):
    """Approximate search of all rows for every 20th, by an inverted file of product codes with exact re-ranking."""
    return _ann(s, d).select("query_id", "vector_id", _score(), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def ann_recall(s, d):
    """Recall of ``ann_every`` against brute force over all its queries: whether it reaches 0.9."""
    found = materialize(_ann(s, d).select("query_id", "vector_id"), "found")
    true = _every(s, d, 20).select("query_id", "vector_id")
    n = every_20th(s, d).agg(F.count(F.lit(1)).alias("n_queries"))
    both = true.join(found.withColumn("hit", F.lit(1)), ["query_id", "vector_id"], "left").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return n.crossJoin(F.broadcast(both)).select("n_queries", (F.col("recall") >= 0.9).alias("enough"))  # one row each


@query(_EV + "SELECT query_id, vector_id, round(score, 6) AS score FROM hit WHERE v = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) <= 5")
def knn_grid(s, d):
    """Search with more queries than are sent at once: blocks of queries meet parts of the vectors."""
    hits = V.scored(frames(s, d), every_20th(s, d), block=20).select("query_id", "vector_id", "video_id", "score")
    return R.top_per_group(hits, ["query_id"], 5).select("query_id", "vector_id", _score())
