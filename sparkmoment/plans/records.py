"""Queries of segments, as-of joins, record fields, constraint lists, registers and relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as RC
from ..functions.keys import VIDEO_KEY_SQL, video_key
from ..functions.text import FOLD_SQL
from ..operators import asof as AO, catalog as C, evaluate as E, lexical as L, objects as O, segments as S
from ..tables import table
from .search import _TILED, every_20th, frames

QUERIES, SQL = {}, {}
_K = VIDEO_KEY_SQL.format("video_id")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# --- segments -----------------------------------------------------------------------------------
_SEGMENTS = _TILED.format(step=10) + """, a AS (SELECT video_id, seg, pos, avg(v0[pos]) AS x FROM t, range(1, 65) r(pos) GROUP BY ALL), z AS (SELECT video_id, seg, sqrt(sum(x * x)) AS n FROM a GROUP BY ALL),
sv AS (SELECT video_id, seg, list(x / n ORDER BY pos) AS v FROM a JOIN z USING (video_id, seg) GROUP BY 1, 2), q AS (SELECT vector_id AS query_id, vec FROM f WHERE vector_id % 20 = 0),
sh AS (SELECT query_id, video_id, seg, round(list_dot_product(v, vec), 9) AS score FROM sv, q),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, seg) AS rank FROM sh QUALIFY rank <= 10)
"""


def _segments(s, d):
    return S.build_segments(frames(s, d), 10)


@query(_SEGMENTS + "SELECT query_id, video_id, CAST(seg AS BIGINT) AS seg, round(score, 6) AS score, rank FROM h")
def segment_search(s, d):
    """The ten segments most like each search's vector."""
    h = S.search_segments(_segments(s, d), every_20th(s, d), 10)
    return h.select("query_id", "video_id", F.col("seg").cast("bigint").alias("seg"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_SEGMENTS + "SELECT query_id, video_id, CAST(seg AS BIGINT) AS seg, round(score, 6) AS score FROM sh WHERE video_id IN (SELECT video_id FROM fr GROUP BY 1 HAVING count(*) % 2 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, seg) <= 10")
def segment_search_videos(s, d):
    """As ``segment_search`` within given videos, here those with an even number of frames."""
    some = frames(s, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 0").select("video_id")
    h = S.search_segments(_segments(s, d), every_20th(s, d), 10, some)
    return h.select("query_id", "video_id", F.col("seg").cast("bigint").alias("seg"), F.round("score", 6).alias("score"))


@query(_SEGMENTS + "SELECT query_id, vector_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), vector_id) AS place FROM h JOIN t USING (video_id, seg) GROUP BY 1, 2")
def segment_frames(s, d):
    """The frames of the segments found, in their order."""
    h = S.frames_of(S.search_segments(_segments(s, d), every_20th(s, d), 10))
    return h.select("query_id", "vector_id", F.col("place").cast("bigint").alias("place"))


# --- as-of --------------------------------------------------------------------------------------
_ASOF = f"""WITH q AS (SELECT request_id, {_K} AS v, requested_timestamp AS t FROM frame_requests), f AS (SELECT vector_id, {_K} AS v, "timestamp" AS ft FROM frames WHERE "timestamp" IS NOT NULL AND NOT isnan("timestamp"))
"""


def _asof(s, d, side: str, tolerance: float | None):
    q = table(s, d, "frame_requests").select("request_id", video_key("video_id").alias("v"), F.col("requested_timestamp").alias("t"))
    f = table(s, d, "frames").select(video_key("video_id").alias("v"), F.col("timestamp").alias("t"), F.col("vector_id").alias("id"))
    return AO.asof(q, f, ["v"], tolerance, side).select("request_id", F.col("id").alias("vector_id"))


@query(_ASOF + "SELECT request_id, arg_min(vector_id, {'d': abs(ft - t), 'i': vector_id}) AS vector_id FROM q LEFT JOIN f ON f.v = q.v AND abs(ft - t) <= 2 AND NOT isnan(t) GROUP BY request_id")
def asof_nearest(s, d):
    """Each request with the frame of its video nearest in time, within two seconds."""
    return _asof(s, d, "nearest", 2.0)


@query(_ASOF + "SELECT request_id, arg_min(vector_id, {'d': t - ft, 'i': vector_id}) AS vector_id FROM q LEFT JOIN f ON f.v = q.v AND ft <= t AND NOT isnan(t) GROUP BY request_id")
def asof_before(s, d):
    """Each request with the last frame at or before it."""
    return _asof(s, d, "before", None)


# --- transcript evidence ------------------------------------------------------------------------
@query(f"SELECT query_id, {_K} AS video_id, round(avg(bm25_score), 6) AS asr, round(coalesce(avg(CASE WHEN dense_score > 0 THEN dense_score END), 0), 6) AS dense, round(0.1 * count(*), 6)::DOUBLE AS object FROM segment_matches GROUP BY 1, 2")
def match_signals(s, d):
    m = table(s, d, "segment_matches").withColumn("video_id", video_key("video_id"))
    return L.match_signals(m).select("query_id", "video_id", *(F.round(c, 6).alias(c) for c in ("asr", "dense", "object")))


@query(f"""WITH m AS (SELECT match_id, query_id, {_K} AS video_id, start, coalesce(frame, CAST(floor(start * 30) AS BIGINT)) AS f FROM segment_matches WHERE start IS NOT NULL),
g AS (SELECT *, lead(start) OVER (PARTITION BY query_id, video_id ORDER BY start, match_id) - start AS gap FROM m),
a AS (SELECT query_id, video_id, count(*) AS n, avg(gap) AS gap, coalesce((arg_max(f, {{'s': start, 'm': match_id}}) - arg_min(f, {{'s': start, 'm': match_id}})) / nullif(max(f) - min(f), 0), 0) AS way FROM g GROUP BY 1, 2)
SELECT query_id, video_id, round(CASE WHEN n < 2 THEN 1.0 ELSE greatest(0.0, least(1.0, exp(-pow(gap, 2) / 1800.0) * exp(-0.01 * way))) END, 6) AS consistency FROM a""")
def time_consistency(s, d):
    m = table(s, d, "segment_matches").withColumn("video_id", video_key("video_id"))
    return L.time_consistency(m, True).select("query_id", "video_id", F.round("consistency", 6).alias("consistency"))


@query("""SELECT record_id, CAST(pos AS BIGINT) AS pos, s.text AS text, s.start AS start, s."end" AS "end" FROM (SELECT record_id, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS s FROM (
SELECT record_id, list_filter(list_transform(segments, lambda s: {'text': trim(regexp_replace(s.text, '[\\s\\p{Z}]+', ' ', 'g')), 'start': s.start, 'end': s."end"}),
  lambda s: coalesce(s.text <> '' AND NOT isnan(s.start) AND NOT isnan(s."end") AND s.start >= 0 AND s.start <= s."end", false)) AS c FROM asr_sidecar))""")
def clean_segments(s, d):
    """Transcript segments without blank texts and impossible times."""
    c = table(s, d, "asr_sidecar").select("record_id", F.posexplode(RC.clean_segments(F.col("segments"))).alias("pos", "s"))
    return c.select("record_id", F.col("pos").cast("bigint").alias("pos"), "s.text", "s.start", "s.end")


# --- record fields ------------------------------------------------------------------------------
_PATH = "regexp_replace(list_last(string_split({0}, '/')), '\\.[^.]*$', '')".format("keyframe_path")


@query(f"SELECT vector_id, coalesce(TRY_CAST(list_last(regexp_extract_all({_PATH}, '\\d+')) AS BIGINT), 0) AS number FROM frames")
def frame_numbers(s, d):
    """Frame number in the name of each key frame's file."""
    return table(s, d, "frames").select("vector_id", RC.frame_number(F.col("keyframe_path")).alias("number"))


_BLOB = FOLD_SQL.format("array_to_string(coalesce(object_labels, []), ' ')")


@query(f"""WITH o AS (SELECT {_K} AS video_id, object_labels, {_BLOB} AS blob FROM frames),
c AS (SELECT video_id, count(*) FILTER (contains(blob, 'boat')) AS a, count(*) FILTER (contains(blob, 'car')) AS b, count(*) FILTER (contains(blob, 'horse')) AS h FROM o WHERE len(object_labels) > 0 GROUP BY 1),
v AS (SELECT DISTINCT video_id FROM o)
SELECT v.video_id, round(coalesce(CASE WHEN a > 0 THEN 0.03 ELSE -0.05 END + CASE WHEN b > 2 THEN 0.03 ELSE -0.06 END + CASE WHEN h < 1 THEN 0.03 ELSE -0.06 END, 0), 6)::DOUBLE AS score FROM v LEFT JOIN c USING (video_id)""")
def constraint_list(s, d):
    """Videos by three constraints on the labels of their frames."""
    f = table(s, d, "frames").select(video_key("video_id").alias("video_id"), F.col("object_labels").alias("labels"))
    wanted = [("attribute", "a boat", "", 0), ("count", "car", ">", 2), ("count", "horse", "<", 1), ("count", " ", "==", 1)]
    return O.verify_all(f.select("video_id").distinct().withColumn("score", F.lit(0.0)), f, wanted).select("video_id", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT * FROM (VALUES (0, ['boat', 'car']), (1, ['horse']), (2, CAST([] AS VARCHAR[]))) t(event, concepts)),
x AS (SELECT vector_id, event, len(list_intersect(concepts, coalesce(object_labels, []))) / nullif(len(concepts), 0)::DOUBLE AS cov FROM frames, e)
SELECT vector_id, event, round(CASE WHEN coalesce(cov, 0) = 0 THEN -0.16 ELSE 0.08 * (2 * cov - 1) END, 6)::DOUBLE AS adjustment FROM x""")
def event_adjustments(s, d):
    """Evidence of every frame's labels for three events of a query."""
    e = s.createDataFrame([(0, ["boat", "car"]), (1, ["horse"]), (2, [])], "event int, concepts array<string>")
    f = table(s, d, "frames").select("vector_id", F.col("object_labels").alias("labels"))
    return O.adjustment_matrix(f, e).select("vector_id", "event", F.round("adjustment", 6).alias("adjustment"))


# --- evaluation ---------------------------------------------------------------------------------
@query(f"""SELECT match_id, CASE WHEN coalesce(m.v = g.v AND frame BETWEEN lo AND hi, false) THEN 1.0 ELSE 0.0 END::DOUBLE AS relevance FROM (SELECT match_id, query_id, {_K} AS v, frame FROM segment_matches) m
JOIN (SELECT kis_id, {VIDEO_KEY_SQL.format('gt_video_id')} AS v, gt_frame_id - 5000 AS lo, gt_frame_id + 5000 AS hi FROM kis_dev) g ON kis_id = query_id""")
def relevance_ranges(s, d):
    """Relevance of each match, its truth a range of frames."""
    m = table(s, d, "segment_matches").select("match_id", "query_id", video_key("video_id").alias("v"), F.array("frame").alias("frames"))
    g = table(s, d, "kis_dev").select(F.col("kis_id").alias("query_id"), video_key("gt_video_id").alias("g"), F.array(F.struct((F.col("gt_frame_id") - 5000).alias("lo"), (F.col("gt_frame_id") + 5000).alias("hi"))).alias("ranges"))
    none = F.lit(None).cast("string")
    return m.join(g, "query_id").select("match_id", E.relevance(F.col("v"), F.col("frames"), none, F.col("g"), F.col("ranges"), none, "kis").alias("relevance"))


@query(f"""WITH v AS (SELECT {_K} AS k, max(fps) AS fps FROM videos GROUP BY 1) SELECT vector_id, CASE WHEN fps > 0 THEN fps END AS fps, round(frame_id / CASE WHEN fps > 0 THEN fps END, 6) AS seconds FROM frames LEFT JOIN v ON k = {_K}""")
def candidate_rates(s, d):
    f = table(s, d, "frames").select("vector_id", video_key("video_id").alias("video_id"), "frame_id")
    v = table(s, d, "videos").select(video_key("video_id").alias("video_id"), "fps")
    return E.with_rates(f, v).select("vector_id", "fps", F.round("seconds", 6).alias("seconds"))


# --- registers ----------------------------------------------------------------------------------
@query("""WITH n AS (SELECT embedding_version, max(model_version) AS model_version FROM frames WHERE embedding_version IS NOT NULL GROUP BY 1), o AS (SELECT embedding_version, model_name, model_version FROM siglip2_meta)
SELECT coalesce(n.embedding_version, o.embedding_version) AS embedding_version, o.model_name, CASE WHEN n.embedding_version IS NULL THEN o.model_version ELSE n.model_version END AS model_version FROM o FULL JOIN n USING (embedding_version)""")
def register_versions(s, d):
    """The register of model versions after what the frames say."""
    old = table(s, d, "siglip2_meta").select("embedding_version", "model_name", "model_version")
    new = table(s, d, "frames").filter("embedding_version is not null").groupBy("embedding_version").agg(F.max("model_version").alias("model_version")).withColumn("model_name", F.lit(None).cast("string"))
    return C.register(old, new, ["embedding_version"], ["model_name"])


@query(f"""WITH o AS (SELECT vector_id, {_K} AS video_id, frame_id FROM manifest_siglip2), n AS (SELECT {_K} AS video_id, frame_id, vector_id AS old_id FROM frames WHERE vector_id NOT IN (SELECT vector_id FROM manifest_siglip2))
SELECT vector_id, video_id, frame_id FROM o UNION ALL SELECT (SELECT max(vector_id) FROM o) + row_number() OVER (ORDER BY video_id NULLS FIRST, frame_id NULLS FIRST, old_id), video_id, frame_id FROM n""")
def appended_frames(s, d):
    """The manifest and the frames it lacks, numbered on."""
    old = table(s, d, "manifest_siglip2").select("vector_id", video_key("video_id").alias("video_id"), "frame_id")
    new = table(s, d, "frames").join(table(s, d, "manifest_siglip2").select("vector_id"), "vector_id", "left_anti").select(video_key("video_id").alias("video_id"), "frame_id", F.col("vector_id").alias("old_id"))
    return C.appended(old.withColumn("old_id", F.lit(None).cast("bigint")), new, ["video_id", "frame_id", "old_id"]).drop("old_id")
