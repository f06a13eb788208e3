"""Queries of the small scores and checks."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.keys import VIDEO_KEY_SQL, video_key
from ..functions.text import FOLD_SQL, fold
from ..operators import signals as S
from ..tables import table
from .search import _CA, candidates

QUERIES, SQL = {}, {}
_K = VIDEO_KEY_SQL.format("video_id")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _wide(s, d):
    """Signals of the three modalities per query and video."""
    m = table(s, d, "modality_signals").filter("not isnan(raw_score) and abs(raw_score) < 1e300 and query_id is not null")
    one = lambda n: F.max(F.when(F.col("name") == n, F.col("normalised"))).alias(n)
    return m.groupBy("query_id", video_key("video_id").alias("video_id")).agg(*(one(n) for n in ("asr", "visual", "object")))


_WIDE = f"""WITH w AS (SELECT query_id, {_K} AS video_id, max(CASE WHEN name = 'asr' THEN normalised END) AS asr, max(CASE WHEN name = 'visual' THEN normalised END) AS visual, max(CASE WHEN name = 'object' THEN normalised END) AS object
FROM modality_signals WHERE NOT isnan(raw_score) AND abs(raw_score) < 1e300 AND query_id IS NOT NULL GROUP BY 1, 2)
"""


@query(_WIDE + "SELECT query_id, video_id, round(0.3 * coalesce(asr, 0) + 0.25 * coalesce(visual, 0) + 0.4 * coalesce(object, 0), 6)::DOUBLE AS score FROM w")
def linear_rank(s, d):
    zero = F.lit(0.0)
    return _wide(s, d).select("query_id", "video_id", F.round(S.linear_rank([zero, zero, F.col("asr"), F.col("visual"), F.col("object"), zero]), 6).alias("score"))


@query(_WIDE + """SELECT query_id, video_id, round(coalesce(visual, 0) + coalesce(least(0.02, 0.05 * CASE WHEN asr IS NULL THEN NULL WHEN max(asr) OVER p - min(asr) OVER p < 1e-9 THEN 0.5 ELSE (asr - min(asr) OVER p) / (max(asr) OVER p - min(asr) OVER p) END), 0), 6)::DOUBLE AS score FROM w WINDOW p AS (PARTITION BY query_id)""")
def bounded_bonus(s, d):
    """Speech as a bonus of at most 0.02 on the visual score."""
    bonus = S.bounded_bonus(F.coalesce("visual", F.lit(0.0)), F.col("asr"), W.partitionBy("query_id"), 0.05)
    return _wide(s, d).select("query_id", "video_id", F.round(bonus, 6).alias("score"))


@query(_WIDE + "SELECT query_id, video_id, round(coalesce(0.65 * visual + 0.35 * object, visual), 6)::DOUBLE AS score FROM w")
def remote_fusion(s, d):
    return _wide(s, d).select("query_id", "video_id", F.round(S.fused_with_remote(F.col("visual"), F.col("object")), 6).alias("score"))


@query(_CA + ", r AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY score DESC) AS r FROM c) SELECT label, round(coalesce(max(CASE WHEN r = 1 THEN score END) - max(CASE WHEN r = 2 THEN score END), 1.0), 6) AS gap FROM r WHERE r <= 2 GROUP BY 1")
def confidence_gap(s, d):
    return S.confidence_gap(candidates(s, d), ["label"]).select("label", F.round("gap", 6).alias("gap"))


_EVW = f"""WITH e AS (SELECT query_id, event_index, importance, regexp_extract_all({FOLD_SQL.format("concat_ws(' ', vi_text, en_text)")}, '[a-z]{{4,}}') AS ws FROM notebook_events),
ew AS (SELECT query_id, event_index, importance, unnest(ws) AS word FROM e), m AS (SELECT query_id, {_K} AS video_id, concat_ws(chr(10), {FOLD_SQL.format('segment_text')}, {FOLD_SQL.format('matched_query')}) AS folded FROM segment_matches),
t AS (SELECT query_id, count(*) AS total, sum(importance) AS weight FROM (SELECT DISTINCT query_id, event_index, importance FROM e) GROUP BY 1),
h AS (SELECT DISTINCT m.query_id, video_id, event_index, importance FROM m JOIN ew ON ew.query_id = m.query_id AND contains(folded, word)),
g AS (SELECT query_id, video_id, count(*) AS matched, sum(importance) AS w FROM h GROUP BY 1, 2)
SELECT query_id, video_id, matched, round(matched / total, 6) AS coverage, round(coalesce(w / nullif(weight, 0), 0), 6) AS weighted FROM g JOIN t USING (query_id)"""


@query(_EVW)
def event_coverage_words(s, d):
    """Planned events with any of their words of four letters in the text or the query of a match; events without such a word count as not found."""
    words = F.regexp_extract_all(fold(F.concat_ws(" ", "vi_text", "en_text")), F.lit("([a-z]{4,})"), 1)
    e = table(s, d, "notebook_events").select("query_id", "event_index", F.explode_outer(F.array_distinct(words)).alias("word"), "importance")
    text = F.concat_ws("\n", fold(F.col("segment_text")), fold(F.col("matched_query")))
    m = table(s, d, "segment_matches").select("query_id", video_key("video_id").alias("video_id"), text.alias("folded"))
    return S.event_coverage(m, e).select("query_id", "video_id", "matched", F.round("coverage", 6).alias("coverage"), F.round("weighted", 6).alias("weighted"))


@query(f"""WITH m AS (SELECT match_id, query_id, {_K} AS video_id, start AS a, bm25_score AS b FROM segment_matches WHERE start IS NOT NULL AND bm25_score IS NOT NULL AND video_id IS NOT NULL),
n AS (SELECT query_id, video_id, count(*) AS n FROM m GROUP BY 1, 2), x AS (SELECT p.query_id, p.video_id, count(*) AS bad FROM m p JOIN m q ON p.query_id = q.query_id AND p.video_id = q.video_id AND p.a < q.a AND p.b > q.b GROUP BY 1, 2)
SELECT query_id, video_id, round(CASE WHEN n < 2 THEN 1.0 ELSE 1 - coalesce(bad, 0) / (n * (n - 1) / 2) END, 6) AS tau FROM n LEFT JOIN x USING (query_id, video_id)""")
def order_share(s, d):
    m = table(s, d, "segment_matches").filter("start is not null and bm25_score is not null and video_id is not null").select("query_id", video_key("video_id").alias("video_id"), "start", "bm25_score")
    return S.order_share(m, ["query_id", "video_id"], "start", "bm25_score").select("query_id", "video_id", F.round("tau", 6).alias("tau"))


@query(f"""WITH f AS (SELECT {_K} AS v, "timestamp" AS t, frame_id FROM frames WHERE isfinite("timestamp") AND frame_id IS NOT NULL), q AS (SELECT {_K} AS v, shot_id, start_s AS t FROM shots WHERE isfinite(start_s))
SELECT shot_id AS target, arg_min(frame_id, {{'t': f.t, 'i': frame_id}}) AS frame_id FROM q JOIN f ON f.v = q.v AND f.t >= q.t GROUP BY 1""")
def forward_frames(s, d):
    """First frame at or after the start of each shot."""
    ok = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    t = table(s, d, "shots").filter(ok("start_s")).select(video_key("video_id").alias("v"), F.col("start_s").alias("t"), F.col("shot_id").alias("target"))
    f = table(s, d, "frames").filter(ok("timestamp") & F.col("frame_id").isNotNull()).select(video_key("video_id").alias("v"), F.col("timestamp").alias("t"), "frame_id")
    return S.forward_frames(t, f, ["v"]).select("target", "frame_id")


@query(_CA + """, x AS (SELECT vector_id, vector_id % 256 AS r, (vector_id * 7) % 256 AS g, (vector_id * 31) % 256 AS b FROM c), y AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM x)
SELECT vector_id, round(60 * CASE WHEN d = 0 THEN 0 WHEN hi = r THEN CASE WHEN g < b THEN (g - b) / d + 6 ELSE (g - b) / d END WHEN hi = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END, 6)::DOUBLE AS h, round(CASE WHEN hi = 0 THEN 0 ELSE d / hi END, 6)::DOUBLE AS s FROM y""")
def rgb_to_hsv(s, d):
    """Hue and saturation of made-up colours."""
    v = F.col("vector_id")
    c = candidates(s, d).select("vector_id", S.hsv(v % 256, v * 7 % 256, v * 31 % 256).alias("x"))
    return c.select("vector_id", F.round("x.h", 6).alias("h"), F.round("x.s", 6).alias("s"))


# --- relational operators that come with the engine -----------------------------------------------
@query("SELECT source, ocr_done, grouping_id(source, ocr_done) AS g, count(*) AS n, count(DISTINCT shot_id) AS shots FROM frames GROUP BY CUBE (source, ocr_done)")
def frames_cube(s, d):
    f = table(s, d, "frames").cube("source", "ocr_done")
    return f.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count_distinct("shot_id").alias("shots"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(s, d):
    x = table(s, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(f"SELECT video_id FROM (SELECT {_K} AS video_id FROM frames INTERSECT SELECT {_K} FROM shots EXCEPT SELECT {_K} FROM moments)")
def set_operations(s, d):
    """Videos with frames and shots but no moments."""
    key = lambda t: table(s, d, t).select(video_key("video_id").alias("video_id"))
    return key("frames").intersect(key("shots")).exceptAll(key("moments").distinct())
