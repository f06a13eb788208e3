"""Queries of alignment, object evidence, catalog upkeep and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.keys import VIDEO_KEY_SQL, video_key
from ..functions.text import NORMALIZE_SQL, normalize_answer
from ..operators import align as A, catalog as C, evaluate as E, objects as O, ranking as R, vector as V
from ..tables import table
from .search import _CA, _FR as _FR0, candidates, events_of, frames

_FR = _FR0.rstrip() + ",\nhit AS (SELECT q.vector_id AS query_id, f.vector_id, f.video_id, list_dot_product(f.vec, q.vec) AS score FROM f, f AS q WHERE q.vector_id IN (0, 1, 2))\n"

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- alignment ----------------------------------------------------------------------------------
def _sim(s, d):
    f = A.positions(frames(s, d))
    scored = V.scored(f, events_of(s, d)).select("video_id", "pos", F.col("query_id").alias("event"), "score")
    return A.similarities(scored, 3)


_SIM = _FR + """, ps AS (SELECT vector_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS pos FROM fr),
sm AS (SELECT video_id, pos, max(score) FILTER (query_id = 0) AS s0, max(score) FILTER (query_id = 1) AS s1, max(score) FILTER (query_id = 2) AS s2 FROM hit JOIN ps USING (vector_id) GROUP BY ALL),
sp AS (SELECT *, max(pos) OVER (PARTITION BY video_id) AS span FROM sm)
"""
_DP = _SIM + """, b1 AS (SELECT *, max({{'v': s0 + 0.005 * pos, 'n': -pos}}) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sp),
d1 AS (SELECT *, s1 + b.v - 0.005 * pos - {decay} * (pos + b.n) / span AS d, -b.n AS p0 FROM b1 WHERE b IS NOT NULL),
b2 AS (SELECT video_id, pos, s2, span, max({{'v': d + 0.005 * pos, 'n': -pos, 'p0': p0}}) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d1),
d2 AS (SELECT video_id, pos, s2 + b.v - 0.005 * pos - {decay} * (pos + b.n) / span AS d, -b.n AS p1, b.p0 AS p0 FROM b2 WHERE b IS NOT NULL),
best AS (SELECT video_id, max({{'d': d, 'n': -pos, 'p1': p1, 'p0': p0}}) AS x FROM d2 GROUP BY 1), al AS (SELECT video_id, x.d AS score, x.p0 AS p0, x.p1 AS p1, -x.n AS p2 FROM best)
"""
_PATH = "CAST(p0 AS VARCHAR) || ',' || CAST(p1 AS VARCHAR) || ',' || CAST(p2 AS VARCHAR)"


def _path(c):
    return F.array_join(F.transform(c, lambda p: p.cast("string")), ",")


@query(_DP.format(decay=0) + f"SELECT video_id, round(score, 6) AS score, {_PATH} AS path FROM al")
def align_trake(s, d):
    return A.align(_sim(s, d), 3).select("video_id", F.round("score", 6).alias("score"), _path("path").alias("path"))


@query(_DP.format(decay="CAST(0.05 AS DOUBLE)") + f"SELECT video_id, round(score, 6) AS score, {_PATH} AS path FROM al")
def align_trake_decay(s, d):
    return A.align(_sim(s, d), 3, decay=A.DECAY["immediate"]).select("video_id", F.round("score", 6).alias("score"), _path("path").alias("path"))


@query(_SIM + "SELECT video_id, CAST(min(pos) FILTER (s1 >= m - 1e-6) AS BIGINT) AS first_pos, CAST(min(pos) FILTER (s1 = m) AS BIGINT) AS last_pos FROM (SELECT *, max(s1) OVER (PARTITION BY video_id) AS m FROM sm) GROUP BY 1")
def align_roles(s, d):
    sim = _sim(s, d)
    pos = lambda role: A.by_role(sim, 1, role).select("video_id", F.col("pos").cast("bigint").alias(f"{role}_pos"))
    return pos("first").join(pos("last"), "video_id")


_LAM = _DP.format(decay=0) + """, lm AS (SELECT *, 1.0 AS l0, exp(-0.01 * (p1 - p0) / CAST(p2 - p0 AS DOUBLE)) AS l1, exp(-0.01 * (p2 - p1) / CAST(p2 - p0 AS DOUBLE)) AS l2 FROM al)
"""


@query(_LAM + "SELECT video_id, round(l1, 6) AS l1, round(l2, 6) AS l2 FROM lm")
def temporal_lambdas(s, d):
    lam = A.align(_sim(s, d), 3).withColumn("l", A.lambdas(F.col("path"), 0.01))
    return lam.select("video_id", F.round(F.element_at("l", 2), 6).alias("l1"), F.round(F.element_at("l", 3), 6).alias("l2"))


@query(_LAM + """SELECT video_id, round(a.s0 * l0 + b.s1 * l1 + c.s2 * l2, 6) AS gated FROM lm JOIN sm a USING (video_id) JOIN sm b USING (video_id) JOIN sm c USING (video_id) WHERE a.pos = p0 AND b.pos = p1 AND c.pos = p2""")
def gating_score(s, d):
    """Similarities along the aligned path, each times its lambda."""
    sim = _sim(s, d)
    al = A.align(sim, 3).withColumn("l", A.lambdas(F.col("path"), 0.01))
    steps = al.select("video_id", "l", F.posexplode("path").alias("event", "pos"))
    own = F.when(F.col("event") == 0, F.col("s0")).when(F.col("event") == 1, F.col("s1")).otherwise(F.col("s2"))
    got = steps.join(sim, ["video_id", "pos"]).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("event", own.alias("s")))).alias("x"), F.first("l").alias("l"))
    return got.select("video_id", F.round(A.gating(F.transform("x", lambda v: v["s"]), F.col("l")), 6).alias("gated"))


@query(_DP.format(decay=0) + "SELECT video_id, round(score / 3 + CASE WHEN starts_with(video_id, 'V0') THEN 0.02 ELSE 0 END, 6) AS score FROM al ORDER BY score DESC, video_id LIMIT 5")
def trake_ranking(s, d):
    """Aligned videos: mean event score, a bonus for preferred id prefixes, best first."""
    al = A.align(_sim(s, d), 3)
    score = F.round(F.col("score") / 3 + F.when(F.col("video_id").startswith("V0"), 0.02).otherwise(0.0), 6)
    return al.select("video_id", score.alias("score")).orderBy(F.desc("score"), "video_id").limit(5)


# --- objects ------------------------------------------------------------------------------------
def _labelled(s, d):
    return table(s, d, "frames").select("vector_id", video_key("video_id").alias("video_id"), F.col("object_labels").alias("labels"))


_K = VIDEO_KEY_SQL.format("video_id")
_OB = f"WITH o AS (SELECT vector_id, {_K} AS video_id, coalesce(object_labels, []) AS labels FROM frames)\n"


@query(_OB + """, c AS (SELECT vector_id, len(list_intersect(['boat', 'car'], labels)) / 2.0 AS cov FROM o)
SELECT vector_id, round(cov, 6) AS coverage, round(CASE WHEN cov = 0 THEN -0.06 ELSE 0.03 * (2 * cov - 1) END, 6) AS adjustment FROM c""")
def object_evidence(s, d):
    cov = O.coverage(F.col("labels"), ["boat", "car"])
    return _labelled(s, d).select("vector_id", F.round(cov, 6).alias("coverage"), F.round(O.evidence_adjustment(cov), 6).alias("adjustment"))


@query(_OB + "SELECT vector_id FROM o WHERE list_has_all(labels, ['boat', 'car']) OR list_has_all(labels, ['horse'])")
def object_filter(s, d):
    """Frames with all labels of one of two event groups."""
    return _labelled(s, d).filter(O.requires_all(F.col("labels"), [["boat", "car"], ["horse"]])).select("vector_id")


@query(_OB + """, g AS (SELECT video_id, bool_or(len(labels) > 0) AS lab, bool_or(list_contains(labels, 'boat')) AS has, count(*) FILTER (list_contains(labels, 'car')) AS n FROM o GROUP BY 1)
SELECT video_id, round(CASE WHEN lab THEN CASE WHEN has THEN 0.03 ELSE -0.05 END + CASE WHEN n >= 3 THEN 0.03 ELSE -0.06 END ELSE 0.0 END, 6)::DOUBLE AS delta FROM g""")
def constraint_verify(s, d):
    return O.verify_constraints(_labelled(s, d), "boat", "car", ">=", 3).select("video_id", F.round("delta", 6).alias("delta"))


@query(_OB + "SELECT label, count(*) AS n FROM (SELECT unnest(list_distinct(labels)) AS label FROM o) GROUP BY 1")
def label_postings(s, d):
    return _labelled(s, d).select(F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(_CA + """, a AS (SELECT vector_id, [label, 'scene', 'scene'] AS e, [CAST(k / 100 AS VARCHAR), '0.35', 'bad'] AS sc, k FROM c)
SELECT vector_id, CASE WHEN k / 100 >= 0.3 THEN CASE WHEN e[1] < 'scene' THEN e[1] || ',scene' ELSE 'scene,' || e[1] END ELSE 'scene' END AS labels FROM a WHERE k IS NOT NULL""")
def label_thresholds(s, d):
    """Detector output (entities and scores as text) reduced by the two thresholds; one score is unreadable and counts 1."""
    c = candidates(s, d).filter("k is not null")
    kept = O.kept_labels(F.array("label", F.lit("scene"), F.lit("scene")), F.array((F.col("k") / 100).cast("string"), F.lit("0.35"), F.lit("bad")))
    return c.select("vector_id", F.array_join(kept, ",").alias("labels"))


# --- catalog ------------------------------------------------------------------------------------
_BATCH = f"""WITH c AS (SELECT (min(epoch_us(ingested_at)) + max(epoch_us(ingested_at))) // 2 AS cut FROM frames),
f AS (SELECT {_K} AS video_id, frame_id, vector_id, source, ocr_done, coalesce(epoch_us(ingested_at) > cut, false) AS late, ingested_at FROM frames, c),
l AS (SELECT *, row_number() OVER (PARTITION BY late, video_id, frame_id ORDER BY ingested_at DESC NULLS LAST, vector_id) AS r FROM f), a AS (SELECT * FROM l WHERE r = 1 AND NOT late), b AS (SELECT * FROM l WHERE r = 1 AND late)
"""


@query(_BATCH + "SELECT coalesce(b.video_id, a.video_id) AS video_id, coalesce(b.frame_id, a.frame_id) AS frame_id, coalesce(b.vector_id, a.vector_id) AS vector_id, coalesce(b.source, a.source) AS source, coalesce(a.ocr_done, b.ocr_done) AS ocr_done FROM a FULL JOIN b ON a.video_id = b.video_id AND a.frame_id = b.frame_id")
def catalog_upsert_batches(s, d):
    """The later half of the deliveries over the earlier: every frame is in one of the two, a frame of both is merged."""
    f = table(s, d, "frames").select(video_key("video_id").alias("video_id"), "frame_id", "vector_id", "source", "ocr_done", "ingested_at")
    at = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    cut = f.select(at.alias("us")).agg(F.expr("(min(us) + max(us)) div 2").alias("cut"))
    f = f.crossJoin(F.broadcast(cut)).withColumn("late", F.coalesce(at > F.col("cut"), F.lit(False)))
    keys = ["video_id", "frame_id"]
    batch = lambda rows: C.latest(rows, keys, [F.desc_nulls_last("ingested_at"), F.asc("vector_id")]).select(*keys, "vector_id", "source", "ocr_done")
    return C.upsert(batch(f.filter("not late")), batch(f.filter("late")), keys, ["vector_id", "source"], ["ocr_done"])


@query(f"""SELECT video_id, frame_id, vector_id FROM (SELECT {_K} AS video_id, frame_id, vector_id, row_number() OVER (PARTITION BY {_K}, frame_id ORDER BY CASE WHEN source = 'btc' THEN 0 ELSE 1 END, ingested_at DESC NULLS LAST, vector_id) AS r FROM frames) WHERE r = 1""")
def latest_frames(s, d):
    """One row per video and frame: the curated source wins, then the latest delivery."""
    f = table(s, d, "frames").select(video_key("video_id").alias("video_id"), "frame_id", "vector_id", "source", "ingested_at")
    order = [F.when(F.col("source") == "btc", 0).otherwise(1), F.desc_nulls_last("ingested_at"), F.asc("vector_id")]
    return C.latest(f, ["video_id", "frame_id"], order).select("video_id", "frame_id", "vector_id")


@query(f"SELECT vector_id AS old_id, row_number() OVER (ORDER BY {_K} NULLS FIRST, frame_id NULLS FIRST, vector_id) - 1 AS vector_id FROM frames")
def regenerate_manifest(s, d):
    """Dense row numbers in (video, frame) order."""
    f = table(s, d, "frames").select(video_key("video_id").alias("video_id"), "frame_id", F.col("vector_id").alias("old_id"))
    return C.dense_ids(f, ["video_id", "frame_id", "old_id"]).select("old_id", F.col("vector_id").cast("bigint").alias("vector_id"))


@query(f"""WITH r AS (SELECT {_K} AS video_id, record_id, CASE WHEN len(segments) > 0 AND batch = 'refresh' THEN 0 ELSE 1 END AS p, coalesce(len(segments), 0) AS n, coalesce(length(text), 0) AS l FROM asr_sidecar WHERE video_id IS NOT NULL)
SELECT video_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY p, n DESC, l DESC, record_id) AS k FROM r) WHERE k = 1""")
def merge_sidecars(s, d):
    """One transcript per video: the refresh batch if it has segments, else most segments, then the longest text."""
    r = table(s, d, "asr_sidecar").filter("video_id is not null").select(video_key("video_id").alias("video_id"), "record_id", "batch", F.coalesce(F.size(F.filter("segments", lambda x: F.lit(True))), F.lit(0)).alias("n"), F.coalesce(F.length("text"), F.lit(0)).alias("l"))
    n = F.greatest("n", F.lit(0))
    order = [F.when((F.col("batch") == "refresh") & (n > 0), 0).otherwise(1), n.desc(), F.desc("l"), F.asc("record_id")]
    return C.latest(r, ["video_id"], order).select("video_id", "record_id")


@query("SELECT vector_id FROM frames WHERE vector_id NOT IN (SELECT vector_id FROM manifest_siglip2)")
def resume_antijoin(s, d):
    """Frames that still need a vector."""
    return C.pending(table(s, d, "frames").select("vector_id"), table(s, d, "manifest_siglip2").select("vector_id"), ["vector_id"])


@query(f"""WITH a AS (SELECT {_K} AS video_id, count(*) AS n_left FROM frames GROUP BY 1), b AS (SELECT {_K} AS video_id, count(*) AS n_right FROM shots GROUP BY 1)
SELECT video_id, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right, CASE WHEN n_right IS NULL THEN 'left' WHEN n_left IS NULL THEN 'right' WHEN n_left <> n_right THEN 'mismatch' ELSE 'both' END AS state FROM a FULL JOIN b USING (video_id)""")
def coverage_fullouter(s, d):
    key = lambda t: table(s, d, t).select(video_key("video_id").alias("video_id"))
    return C.compare_counts(key("frames"), key("shots"), "video_id")


@query("SELECT source, count(*) AS n FROM frames GROUP BY 1")
def source_counts(s, d):
    return table(s, d, "frames").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_K} AS video_id, count(*) AS n, min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM frames GROUP BY 1")
def probe_features(s, d):
    f = table(s, d, "frames").groupBy(video_key("video_id").alias("video_id"))
    return f.agg(F.count(F.lit(1)).alias("n"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))


@query(f"""WITH v AS (SELECT {_K} AS k, fps FROM videos)
SELECT request_id, CAST(coalesce(CASE WHEN v.fps > 0 THEN round_even(greatest(requested_timestamp, 0) * v.fps, 0) END, 0) AS BIGINT) AS frame FROM frame_requests r LEFT JOIN v ON v.k = {VIDEO_KEY_SQL.format('r.video_id')} WHERE requested_timestamp IS NOT NULL""")
def nominal_frames(s, d):
    """Frame numbers by the video's nominal rate."""
    v = table(s, d, "videos").select(video_key("video_id").alias("k"), F.col("fps").alias("rate"))
    r = table(s, d, "frame_requests").filter("requested_timestamp is not null").select("request_id", video_key("video_id").alias("k"), "requested_timestamp")
    return r.join(v, "k", "left").select("request_id", C.seconds_to_frame(F.col("requested_timestamp"), F.col("rate")).alias("frame"))


@query(f"""WITH v AS (SELECT {_K} AS k, fps FROM videos)
SELECT vector_id, round(greatest(CASE WHEN frame_unit = 'ms' THEN frame_id / 1000.0 ELSE coalesce("timestamp", CASE WHEN fps > 0 THEN frame_id / fps END) END, 0.0), 6) AS seconds FROM frames f LEFT JOIN v ON v.k = {VIDEO_KEY_SQL.format('f.video_id')}
WHERE CASE WHEN frame_unit = 'ms' THEN frame_id / 1000.0 ELSE coalesce("timestamp", CASE WHEN fps > 0 THEN frame_id / fps END) END IS NOT NULL""")
def frame_seconds(s, d):
    v = table(s, d, "videos").select(video_key("video_id").alias("k"), "fps")
    f = table(s, d, "frames").select("vector_id", video_key("video_id").alias("k"), "frame_id", "frame_unit", "timestamp")
    known = F.when(F.col("frame_unit") == "ms", F.col("frame_id") / 1000.0).otherwise(F.coalesce("timestamp", F.when(F.col("fps") > 0, F.col("frame_id") / F.col("fps"))))
    sec = C.frame_to_seconds(F.col("frame_id"), F.col("frame_unit"), F.col("timestamp"), F.col("fps"))
    return f.join(v, "k", "left").filter(known.isNotNull()).select("vector_id", F.round(sec, 6).alias("seconds"))


@query(f"""WITH f AS (SELECT {_K} AS v, vector_id, "timestamp" AS t FROM frames WHERE isfinite("timestamp")), s AS (SELECT {_K} AS v, shot_id, start_s, end_s FROM shots WHERE isfinite(start_s) AND isfinite(end_s) AND start_s <= end_s)
SELECT vector_id AS point_id, arg_min(shot_id, {{'l': end_s - start_s, 'i': shot_id}}) AS shot_id FROM f JOIN s ON f.v = s.v AND start_s <= t AND t <= end_s GROUP BY 1""")
def narrowest_interval(s, d):
    p = table(s, d, "frames").select(video_key("video_id").alias("video_id"), F.col("vector_id").alias("point_id"), F.col("timestamp").alias("t"))
    i = table(s, d, "shots").select(video_key("video_id").alias("video_id"), "shot_id", F.col("start_s").alias("s"), F.col("end_s").alias("e"))
    return C.narrowest_interval(p, i)


@query(f"""SELECT vector_id, round(abs("timestamp" - 100), 6) AS away FROM frames WHERE {_K} = 'L0000_V000' AND "timestamp" BETWEEN 40 AND 160""")
def frames_in_window(s, d):
    f = table(s, d, "frames").select("vector_id", video_key("video_id").alias("video_id"), "timestamp")
    return C.frames_in_window(f, "L0000_V000", 100.0, 60.0).select("vector_id", F.round("away", 6).alias("away"))


@query(f"""WITH RECURSIVE v AS (SELECT vector_id, embedding_version AS version, CAST(vec AS DOUBLE[]) AS v0 FROM manifest_siglip2 JOIN siglip2_meta USING (embedding_version) WHERE len(vec) = embedding_dim AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
f AS (SELECT v.vector_id, version, {_K} AS video_id, "timestamp" AS t, coalesce(source = 'btc', false) AS own, list_transform(v0, lambda x: x / greatest(sqrt(list_dot_product(v0, v0)), 1e-12)) AS u FROM frames JOIN v USING (vector_id) WHERE "timestamp" IS NOT NULL AND NOT isnan("timestamp")),
m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY version, video_id ORDER BY t, vector_id) AS i FROM f),
k AS (SELECT version, video_id, i, vector_id, true AS stays, [{{'t': t, 'u': u, 'own': own}}] AS kept FROM m WHERE i = 1 UNION ALL
  SELECT version, video_id, i, vector_id, stays, CASE WHEN stays THEN list_append(near, {{'t': t, 'u': u, 'own': own}}) ELSE near END
  FROM (SELECT *, len(list_filter(near, lambda x: list_dot_product(x.u, u) >= 0.98 AND (x.own OR NOT own))) = 0 AS stays
    FROM (SELECT m.*, list_filter(k.kept, lambda x: m.t - x.t <= 0.5) AS near FROM k JOIN m ON m.version = k.version AND m.video_id IS NOT DISTINCT FROM k.video_id AND m.i = k.i + 1)))
SELECT video_id, vector_id FROM k WHERE stays""")
def frame_dedup(s, d):
    """Near-duplicate frames of ``manifest_siglip2`` dropped per version and video in time order; vectors have their version's size."""
    dim = table(s, d, "siglip2_meta").select("embedding_version", "embedding_dim")  # a row per version
    v = table(s, d, "manifest_siglip2").select("vector_id", "embedding_version", "vec").join(F.broadcast(dim), "embedding_version").filter(F.size("vec") == F.col("embedding_dim"))
    f = table(s, d, "frames").select("vector_id", video_key("video_id").alias("video_id"), "timestamp", F.coalesce("source", F.lit("")).alias("source")).filter("timestamp is not null and not isnan(timestamp)")
    return C.dedup_frames(f.join(v.drop("embedding_dim"), "vector_id"), keys=["embedding_version", "video_id"]).select("video_id", "vector_id")


@query("""WITH s AS (SELECT shot_id, start_s AS a, end_s AS b FROM shots WHERE isfinite(start_s) AND isfinite(end_s)),
n AS (SELECT *, CASE WHEN b - a < 5 THEN 3 WHEN b - a < 15 THEN 5 ELSE 7 END AS n FROM s)
SELECT shot_id, CAST(i AS BIGINT) AS i, round(CASE WHEN b <= a THEN (a + b) / 2 ELSE a + i * (b - a) / (n - 1) END, 6) AS t FROM n, range(0, 7) r(i) WHERE i < CASE WHEN b <= a THEN 1 ELSE n END""")
def adaptive_sampling(s, d):
    ok = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    x = table(s, d, "shots").filter(ok("start_s") & ok("end_s"))
    return x.select("shot_id", F.posexplode(C.sample_times(F.col("start_s"), F.col("end_s"))).alias("i", "t")).select("shot_id", F.col("i").cast("bigint").alias("i"), F.round("t", 6).alias("t"))


@query("""WITH v AS (SELECT video_id, frame_count / fps AS dur FROM videos WHERE fps > 0 AND frame_count IS NOT NULL) SELECT video_id, CAST(greatest(floor(dur * 0.1), 0) AS BIGINT) AS n, round(CASE WHEN floor(dur * 0.1) > 0 THEN (floor(dur * 0.1) - 0.5) / 0.1 END, 6) AS last FROM v""")
def uniform_sampling(s, d):
    v = table(s, d, "videos").filter("fps > 0 and frame_count is not null").withColumn("t", C.uniform_times(F.col("frame_count") / F.col("fps"), 0.1))
    return v.select("video_id", F.size("t").cast("bigint").alias("n"), F.round(F.when(F.size("t") > 0, F.element_at("t", -1)), 6).alias("last"))


@query(_CA + """, n AS (SELECT *, lag(score) OVER w AS p, lead(score) OVER w AS q FROM c WINDOW w AS (PARTITION BY video_id ORDER BY timestamp, vector_id)) SELECT vector_id FROM n WHERE score > 35 AND score >= p AND score >= q""")
def motion_peaks(s, d):
    return C.local_peaks(candidates(s, d), "video_id", "timestamp", "score", 35.0).select("vector_id")


@query(_CA.replace("WITH", "WITH RECURSIVE", 1) + """, n AS (SELECT *, lag(score) OVER w AS p, lead(score) OVER w AS q FROM c WINDOW w AS (PARTITION BY video_id ORDER BY timestamp, vector_id)),
m AS (SELECT video_id, timestamp AS t, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, timestamp, vector_id) AS i FROM n WHERE score > 35 AND score >= p AND score >= q),
k AS (SELECT video_id, i, [t] AS picked FROM m WHERE i = 1 UNION ALL
  SELECT m.video_id, m.i, CASE WHEN len(picked) < 30 AND len(list_filter(picked, lambda x: abs(x - m.t) < 86400)) = 0 THEN list_append(picked, m.t) ELSE picked END FROM k JOIN m ON m.video_id = k.video_id AND m.i = k.i + 1)
SELECT video_id, CAST(len(arg_max(picked, i)) AS BIGINT) AS n, round(list_min(arg_max(picked, i)), 3) AS first FROM k GROUP BY 1""")
def motion_peaks_spaced(s, d):
    p = C.local_peaks(candidates(s, d), "video_id", "timestamp", "score", 35.0)
    return C.spaced(p, ["video_id"], "timestamp", "score", "vector_id", 86400.0, 30).select("video_id", F.size("times").cast("bigint").alias("n"), F.round(F.element_at("times", 1), 3).alias("first"))


@query("SELECT embedding_version, count(*) AS n, count(*) FILTER (len(vec) IS DISTINCT FROM embedding_dim) AS n_wrong_dim, count(*) FILTER (vector_id NOT IN (SELECT vector_id FROM frames)) AS n_no_frame FROM manifest_siglip2 LEFT JOIN siglip2_meta USING (embedding_version) GROUP BY 1")
def validate_vectors(s, d):
    """Vectors per version: how many, of the wrong length, without a frame."""
    m = table(s, d, "manifest_siglip2").select("vector_id", "embedding_version", F.when(F.col("vec").isNotNull(), F.size("vec")).alias("n"))
    dim = table(s, d, "siglip2_meta").select("embedding_version", "embedding_dim")
    known = table(s, d, "frames").select("vector_id", F.lit(True).alias("known")).distinct()
    x = m.join(dim, "embedding_version", "left").join(known, "vector_id", "left")
    return x.groupBy("embedding_version").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("n").eqNullSafe(F.col("embedding_dim"))).alias("n_wrong_dim"), F.count_if(F.col("known").isNull()).alias("n_no_frame"))


# --- evaluation ---------------------------------------------------------------------------------
_RK = f"""WITH m AS (SELECT query_id, {_K} AS video_id, frame, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC NULLS LAST, match_id) AS rank FROM segment_matches),
g AS (SELECT kis_id, {VIDEO_KEY_SQL.format('gt_video_id')} AS gv, gt_frame_id FROM kis_dev),
r AS (SELECT query_id, rank, CASE WHEN coalesce(video_id = gv AND (gt_frame_id IS NULL OR abs(frame - gt_frame_id) <= 50), false) THEN 1::DOUBLE ELSE 0::DOUBLE END AS relevance FROM m JOIN g ON g.kis_id = m.query_id WHERE rank <= 100)
"""


def _judged(s, d, tolerance: int = 50):
    """Matches ranked per query beside the dev set's truth, as the evaluation does."""
    w = W.partitionBy("query_id").orderBy(F.desc_nulls_last("bm25_score"), "match_id")
    m = table(s, d, "segment_matches").select("query_id", video_key("video_id").alias("video_id"), "frame", F.row_number().over(w).alias("rank")).filter("rank <= 100")
    g = table(s, d, "kis_dev").select(F.col("kis_id").alias("query_id"), video_key("gt_video_id").alias("gv"), "gt_frame_id")
    hit = E.is_hit(F.col("video_id"), F.col("frame"), F.col("gv"), F.col("gt_frame_id"), tolerance)
    return m.join(g, "query_id").select("query_id", "rank", F.when(hit, 1.0).otherwise(0.0).alias("relevance"))


_AT = {k: f"max(CASE WHEN rank <= {k} THEN relevance ELSE 0 END)" for k in E.CUTOFFS}


@query(_RK + "SELECT query_id, " + ", ".join(f"{x} AS r{k}" for k, x in _AT.items()) + f", round(({' + '.join(_AT.values())}) / 5, 6) AS final FROM r GROUP BY 1")
def eval_recall_frames(s, d):
    """Recall at several ranks; a hit is within 50 frames of the truth."""
    return E.recalls(_judged(s, d, 50), "query_id").withColumn("final", F.round("final", 6))


@query(_RK + ", p AS (SELECT *, sum(relevance) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / rank AS p FROM r) SELECT query_id, round(coalesce(sum(relevance * p) / nullif(sum(relevance), 0), 0), 6) AS ap FROM p GROUP BY 1")
def eval_ap_frames(s, d):
    """Average precision; a hit is within 50 frames of the truth."""
    return E.average_precision(_judged(s, d, 50), "query_id").select("query_id", F.round("ap", 6).alias("ap"))


@query(_CA + """, o AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY score) AS r, count(*) OVER (PARTITION BY label) AS n FROM c)
SELECT label, max(n) AS n, round(quantile_cont(score, 0.5), 6) AS p50, round(max(CASE WHEN r = floor(0.95 * (n + 1)) THEN score END) + max(0.95 * (n + 1) - floor(0.95 * (n + 1))) * (max(CASE WHEN r = floor(0.95 * (n + 1)) + 1 THEN score END) - max(CASE WHEN r = floor(0.95 * (n + 1)) THEN score END)), 6) AS p95 FROM o GROUP BY 1""")
def eval_latency_quantiles(s, d):
    return E.latency_quantiles(candidates(s, d), ["label"], "score").select("label", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("""WITH a AS (SELECT event_id, {v} AS p, {e} AS g FROM notebook_events) SELECT event_id, coalesce(p <> '' AND g <> '' AND (p = g OR regexp_replace(p, '^màu ', '') = regexp_replace(g, '^màu ', '')), false) AS same FROM a""".format(v=NORMALIZE_SQL.format("vi_text"), e=NORMALIZE_SQL.format("coalesce(en_text, vi_text)")))
def answer_match(s, d):
    n = table(s, d, "notebook_events")
    return n.select("event_id", E.answers_match(normalize_answer(F.col("vi_text")), normalize_answer(F.coalesce("en_text", "vi_text"))).alias("same"))


@query("""SELECT kis_id, gt_video_id || ',' || coalesce(CAST(gt_frame_id AS VARCHAR), '') || ',' || CASE WHEN regexp_matches(query, '[,"\\r\\n]') OR regexp_replace(query, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') <> query THEN '"' || replace(query, '"', '""') || '"' ELSE query END AS line FROM kis_dev WHERE query IS NOT NULL AND gt_video_id IS NOT NULL""")
def csv_rows(s, d):
    k = table(s, d, "kis_dev").filter("query is not null and gt_video_id is not null")
    frame = F.array(F.coalesce(F.col("gt_frame_id").cast("string"), F.lit("")))
    return k.select("kis_id", E.csv_row(F.col("gt_video_id"), frame, F.col("query")).alias("line"))


@query(f"""WITH m AS (SELECT query_id, {_K} AS video_id, frame, match_id, bm25_score AS score FROM segment_matches WHERE frame IS NOT NULL AND video_id IS NOT NULL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame ORDER BY score DESC NULLS LAST, match_id) AS k FROM m) WHERE k = 1)
SELECT query_id, video_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, match_id) AS r FROM b) WHERE r <= 10""")
def finalize_answers(s, d):
    """Ten answers per query, one per video and frame."""
    m = table(s, d, "segment_matches").select("query_id", video_key("video_id").alias("video_id"), "frame", F.col("match_id").alias("vector_id"), F.coalesce("bm25_score", F.lit(float("-inf"))).alias("score")).filter("frame is not null and video_id is not null")
    return R.top_per_group(R.best_per(m, ["query_id", "video_id", "frame"]), ["query_id"], 10).select("query_id", "video_id", "frame")
