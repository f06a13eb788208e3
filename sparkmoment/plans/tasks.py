"""The four tasks as compositions of the operators: known item, question, ordered events, transcript.

Models (text and image encoders, answerers) stay outside: a task takes the vectors and terms that
they produce, and an answerer is a function from rows to rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.keys import VIDEO_KEY_SQL, video_key
from ..functions.text import FOLD_SQL, SPEECH_SQL, TOKENS_SQL, fold, speech_words, tokens
from ..functions.vectors import dot, normalize
from ..operators import align as A, lexical as L, objects as O, ranking as R, vector as V
from ..store import materialize
from ..tables import table
from . import lexical, search

#: Sizes of the pools: frames per list, answers, videos of the coarse stage, frames per video.
POOL, ANSWERS, COARSE, PER_VIDEO = 500, 100, 200, 20


def hybrid(frames: DataFrame, index: L.Bm25, qvecs: DataFrame, terms: DataFrame, pool: int = POOL, vector_weight: float = 1.0, term_weight: float = 0.8) -> DataFrame:
    """(query_id, vector_id, score): vector list and BM25 list of each search, ``pool`` long, fused by rank.

    ``qvecs`` has (query_id, v, qvec): a search's variants v = 0, 1, ... weigh 1, .8, .65, ... down to .2 of
    ``vector_weight``. ``terms`` has (query_id, term). Scores equal to nine decimals are ranked by id.
    """
    flat = qvecs.withColumn("search", F.col("query_id")).withColumn("query_id", F.struct("search", "v"))
    ranked = V.knn(frames, flat, pool)
    v = F.col("query_id.v")
    weight = vector_weight * F.when(v == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.2), 0.8 - 0.15 * (v - 1)))
    lists = ranked.select(F.col("query_id.search").alias("query_id"), F.col("vector_id").alias("id"), "rank", weight.alias("weight"))
    found = L.bm25_search(index, terms, pool).select("query_id", F.col("key").alias("id"), "rank", F.lit(term_weight).alias("weight"))
    both = lists.unionByName(found).repartition("query_id")  # a search's lists are ``pool`` long
    return R.rrf(both, None, pool, ["query_id"]).select("query_id", F.col("id").alias("vector_id"), "score")


def kis(frames: DataFrame, fused: DataFrame, concepts: DataFrame | None = None, answers: int = ANSWERS, per_video: int = PER_VIDEO, prefixes: Sequence[str] = (), evidence_weight: float = 0.03) -> DataFrame:
    """Known-item search: (query_id, video_id, frame_id, vector_id, score, rank) of many searches at once.

    ``frames`` has (vector_id, video_id, frame_id, labels), ``fused`` is what ``hybrid`` returns. Evidence
    of the labels for a search's ``concepts`` (query_id, concepts) is added, repeated frames are merged,
    each video is capped and the first ``answers`` are kept. ``prefixes`` limit the videos.
    """
    rows = frames.select("vector_id", "video_id", "frame_id", "labels").join(fused, "vector_id")
    if prefixes:
        rows = rows.filter(reduce(Column.__or__, [F.col("video_id").startswith(p) for p in prefixes]))
    if concepts is not None:
        rows = rows.join(concepts, "query_id", "left")
        wanted = F.array_distinct("concepts")
        share = F.size(F.array_intersect(F.coalesce("labels", F.array().cast("array<string>")), wanted)) / F.nullif(F.size(wanted), F.lit(0))
        rows = rows.withColumn("score", F.col("score") + F.coalesce(O.evidence_adjustment(share, evidence_weight), F.lit(0.0)))
    rows = rows.select("query_id", "video_id", "frame_id", "vector_id", "score").repartition("query_id")  # few rows a search, ranked where they lie
    best = R.best_per(rows, ["query_id", "video_id", "frame_id"])
    out = R.diversify(best, per_video, answers, ["query_id"])
    return out.select("query_id", "video_id", "frame_id", "vector_id", "score", "rank")


def qa(candidates: DataFrame, answerer: Callable[[DataFrame], DataFrame], videos: int = 10) -> DataFrame:
    """Candidates of each search's first ``videos`` videos with the answer for their video's best frame.

    ``answerer`` maps rows (query_id, video_id, vector_id) to (query_id, video_id, answer); videos without one have null.
    """
    candidates = materialize(candidates, "candidates")  # read three times
    first = candidates.groupBy("query_id", "video_id").agg(F.min("rank").alias("first"), F.min_by("vector_id", "rank").alias("vector_id"))
    first = first.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("first"))).filter(F.col("r") <= videos)
    answers = answerer(first.select("query_id", "video_id", "vector_id")).select("query_id", "video_id", "answer")
    return candidates.join(first.select("query_id", "video_id"), ["query_id", "video_id"], "left_semi").join(answers, ["query_id", "video_id"], "left")


def trake(frames: DataFrame, events: DataFrame, n_events: int, coarse: int = COARSE, top: int = ANSWERS, penalty: float = A.PENALTY, decay: float = 0.0, preferred: Sequence[str] = ()) -> DataFrame:
    """Ordered events: (video_id, score, frames), one frame id per event in increasing order.

    ``events`` has (query_id 0.., qvec). Only the ``coarse`` videos whose mean vector is most similar
    to the events' centroid are aligned.
    """
    centre = V.mean_pool(events.select(F.lit(0).alias("g"), normalize(F.col("qvec")).alias("vec")), ["g"]).select(F.col("vec").alias("centre"))
    pooled = V.mean_pool(frames, ["video_id"]).crossJoin(F.broadcast(centre))
    near = pooled.select("video_id", dot(F.col("vec"), F.col("centre")).alias("s")).orderBy(F.desc("s"), "video_id").limit(coarse).select("video_id")
    # The frames of at most ``coarse`` videos, written once: they are numbered, scored and named from there.
    chosen = materialize(frames.join(near, "video_id", "left_semi").select("video_id", "frame_id", "vector_id", "vec"), "chosen")
    chosen = materialize(A.positions(chosen), "placed")
    sim = A.similarities(V.scored(chosen, events).select("video_id", "pos", F.col("query_id").alias("event"), "score"), n_events)
    found = A.align(sim, n_events, penalty, decay)
    bonus = F.lit(0.0)
    for p in preferred:
        bonus = F.when(F.col("video_id").startswith(p), F.lit(0.02)).otherwise(bonus)
    best = found.withColumn("score", F.col("score") / n_events + bonus).orderBy(F.desc("score"), "video_id").limit(top)
    steps = best.select("video_id", "score", F.posexplode("path").alias("event", "pos"))
    named = steps.join(chosen.select("video_id", "pos", "frame_id"), ["video_id", "pos"])
    return named.groupBy("video_id", "score").agg(F.transform(F.array_sort(F.collect_list(F.struct("event", "frame_id"))), lambda x: x["frame_id"]).alias("frames"))


def notebook(segments: DataFrame, index: L.Bm25, queries: Sequence[Sequence[str]], concepts: Sequence[str], top: int = 5, per_query: int = 10, cap: int = 100) -> DataFrame:
    """Transcript search: (video_id, score, n, start, text) of the best videos with their best segment.

    ``index`` holds the segments by "video_id:seg_idx". Each planned query's terms search it; the hits (at
    most ``cap``) are gathered per video into evidence and scored. ``concepts`` are the folded key words of the events.
    """
    spark = segments.sparkSession
    terms = spark.createDataFrame([(i, t) for i, q in enumerate(queries) for t in q], "query_id bigint, term string")
    hits = L.bm25_search(index, terms, per_query)
    hits = hits.groupBy("key").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "key").limit(cap)
    m = segments.withColumn("key", F.concat_ws(":", "video_id", "seg_idx")).join(F.broadcast(hits), "key")  # ``cap`` rows
    m = m.select(F.lit(0).alias("query_id"), "video_id", F.col("seg_idx").alias("match_id"), "start", F.col("score").alias("bm25_score"), F.lit(0.0).alias("dense_score"), "text")
    covered = m.select("video_id", F.explode(F.array(*(F.when(F.contains(fold(F.col("text")), F.lit(c)), F.lit(c)) for c in concepts))).alias("c")).groupBy("video_id").agg((F.count_distinct("c") / F.lit(float(len(concepts)))).alias("coverage"))
    scored = L.video_scores(L.evidence(m).join(covered, "video_id", "left"), F.coalesce("coverage", F.lit(0.0)), F.lit(0.0))
    best = m.groupBy("video_id").agg(F.max_by(F.struct("start", "text"), F.struct("bm25_score", -F.col("match_id"))).alias("b"))
    return scored.join(best, "video_id").select("video_id", "score", "n", "b.start", "b.text").orderBy(F.desc(F.round("score", 9)), "video_id").limit(top)


# --- queries ------------------------------------------------------------------------------------
#: The version whose vectors are searched.
VERSION = "visemb-base-r2"


def _frames(s: SparkSession, d: str) -> DataFrame:
    """Frames with a usable vector of the version, as long as the version's dimension."""
    good = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    dims = table(s, d, "siglip2_meta").filter(F.col("embedding_version") == VERSION).select("embedding_version", "embedding_dim").distinct()
    v = table(s, d, "manifest_siglip2").filter(good).join(dims, "embedding_version").filter(F.size("vec") == F.col("embedding_dim")).select("vector_id", "vec")
    f = table(s, d, "frames").select("vector_id", video_key("video_id").alias("video_id"), "frame_id", F.col("object_labels").alias("labels"), F.concat_ws(" ", "title", "description", F.array_join("object_labels", " ")).alias("text"))
    return f.join(v, "vector_id")


_FRAMES_SQL = f"""WITH f0 AS MATERIALIZED (SELECT f.vector_id, {VIDEO_KEY_SQL.format('f.video_id')} AS video_id, f.frame_id, f.object_labels AS labels, concat_ws(' ', title, description, array_to_string(object_labels, ' ')) AS text, CAST(vec AS DOUBLE[]) AS v0
  FROM frames f JOIN manifest_siglip2 m USING (vector_id) JOIN siglip2_meta t ON t.embedding_version = m.embedding_version AND t.embedding_version = '{VERSION}' AND len(vec) = embedding_dim
  WHERE len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
f AS MATERIALIZED (SELECT * EXCLUDE v0, v0, list_transform(v0, lambda x: x / greatest(sqrt(list_dot_product(v0, v0)), 1e-12)) AS vec FROM f0),
"""


def _searches(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every frame whose id is divisible by 20 as a search for frames like it: its vector, the words of its labels, the labels."""
    q = frames.filter(F.col("vector_id") % 20 == 0).select(F.col("vector_id").alias("query_id"), F.lit(0).alias("v"), F.col("vec").alias("qvec"), "labels")
    terms = q.select("query_id", F.explode(tokens(F.array_join("labels", " "))).alias("term"))
    return q.select("query_id", "v", "qvec"), terms, q.select("query_id", F.col("labels").alias("concepts"))


def _hybrid(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frames, what ``hybrid`` finds and the searches' concepts."""
    frames = materialize(_frames(s, d), "frames")
    index = lexical.indexed(s, d, "frames", lambda: L.bm25_index(frames, "vector_id", tokens(F.col("text"))))
    q, terms, concepts = _searches(frames)
    return frames, hybrid(frames, index, q, terms), concepts


def _hybrid_sql() -> str:
    words = TOKENS_SQL.format("text")
    return _FRAMES_SQL + f"""q AS (SELECT vector_id AS query_id, vec, labels, {TOKENS_SQL.format("array_to_string(labels, ' ')")} AS qw FROM f WHERE vector_id % 20 = 0),
vh AS (SELECT query_id, f.vector_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(f.vec, q.vec), 9) DESC, f.vector_id) AS rank FROM f, q QUALIFY rank <= {POOL}),
d AS (SELECT vector_id AS key, {words} AS words FROM f), st AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM d),
tf AS (SELECT key, dl, term, count(*) AS tf FROM (SELECT key, len(words) AS dl, unnest(words) AS term FROM d) GROUP BY ALL),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st),
idf AS (SELECT term, CASE WHEN idf < 0 THEN greatest(0.25 * (SELECT avg(idf) FROM raw), 1e-9) ELSE idf END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(qw) AS term FROM q) GROUP BY 1, 2),
sc AS (SELECT query_id, key, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term), st GROUP BY 1, 2),
bh AS (SELECT query_id, key AS vector_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {POOL}),
hy AS (SELECT query_id, vector_id, sum(w / ({min(60, max(1, round(1 + 59 * POOL / 2000)))} + rank)) AS score FROM (SELECT query_id, vector_id, rank, 1.0 AS w FROM vh UNION ALL SELECT query_id, vector_id, rank, 0.8 FROM bh) GROUP BY 1, 2)"""


_KIS_SQL = _hybrid_sql() + f""",
ev AS (SELECT query_id, f.vector_id, video_id, frame_id, f.labels, list_distinct(q.labels) AS c, score FROM hy JOIN f USING (vector_id) JOIN q USING (query_id)),
ad AS (SELECT *, len(list_filter(c, lambda x: x IS NOT NULL AND list_contains(coalesce(labels, []), x))) / nullif(len(c), 0)::DOUBLE AS cov FROM ev),
sc2 AS (SELECT query_id, vector_id, video_id, frame_id, score + coalesce(CASE WHEN cov = 0 THEN -0.06 WHEN cov > 0 THEN 0.03 * (2 * cov - 1) END, 0) AS score FROM ad),
b1 AS (SELECT * FROM sc2 WHERE video_id IS NOT NULL AND frame_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, video_id, frame_id ORDER BY score DESC, vector_id) = 1),
b2 AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, vector_id) <= {PER_VIDEO}),
ki AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank FROM b2 QUALIFY rank <= {ANSWERS})"""


def hybrid_rrf(s, d):
    """Vector and BM25 lists of every search, fused by rank."""
    return _hybrid(s, d)[1].select("query_id", "vector_id", F.round("score", 9).alias("score"))


def _kis(s, d) -> DataFrame:
    return kis(*_hybrid(s, d))


def task_kis(s, d):
    return _kis(s, d).select("query_id", "video_id", "frame_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def task_qa(s, d):
    """As task_kis; the answer is the video's most frequent label among its frames."""

    def most_frequent(rows: DataFrame) -> DataFrame:
        labels = table(s, d, "frames").select(video_key("video_id").alias("video_id"), F.explode("object_labels").alias("answer"))
        n = labels.groupBy("video_id", "answer").agg(F.count(F.lit(1)).alias("n")).groupBy("video_id").agg(F.max_by("answer", F.struct("n", "answer")).alias("answer"))
        return rows.join(n, "video_id")

    return qa(_kis(s, d), most_frequent).select("query_id", "video_id", "frame_id", F.col("rank").cast("bigint").alias("rank"), "answer")


def task_trake(s, d):
    return trake(_frames(s, d), search.events_of(s, d), 3, preferred=["L"]).select("video_id", F.round("score", 6).alias("score"), F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


_TRAKE_SQL = _FRAMES_SQL + f"""e AS (SELECT vec_id AS event, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS vec FROM embeddings WHERE vec_id IN (0, 1, 2)),
cu AS (SELECT pos, avg(vec[pos]) AS y FROM e, range(1, 65) r(pos) GROUP BY 1), mv AS (SELECT video_id, pos, avg(v0[pos]) AS x FROM f, range(1, 65) r(pos) GROUP BY ALL), mn AS (SELECT video_id, sqrt(sum(x * x)) AS n FROM mv GROUP BY 1),
co AS (SELECT video_id FROM mv JOIN cu USING (pos) JOIN mn USING (video_id) WHERE video_id IS NOT NULL GROUP BY 1 ORDER BY sum(x * y) / any_value(n) DESC, video_id LIMIT {COARSE}),
fp AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id NULLS FIRST, vector_id) - 1 AS pos FROM f WHERE video_id IN (SELECT video_id FROM co)),
sp AS (SELECT video_id, pos, max(list_dot_product(fp.vec, e.vec)) FILTER (event = 0) AS s0, max(list_dot_product(fp.vec, e.vec)) FILTER (event = 1) AS s1, max(list_dot_product(fp.vec, e.vec)) FILTER (event = 2) AS s2 FROM fp, e GROUP BY 1, 2),
b1 AS (SELECT *, max({{'v': s0 + 0.005 * pos, 'n': -pos}}) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sp),
d1 AS (SELECT *, s1 + b.v - 0.005 * pos AS d, -b.n AS p0 FROM b1 WHERE b IS NOT NULL),
b2 AS (SELECT video_id, pos, s2, max({{'v': d + 0.005 * pos, 'n': -pos, 'p0': p0}}) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d1),
d2 AS (SELECT video_id, pos, s2 + b.v - 0.005 * pos AS d, -b.n AS p1, b.p0 AS p0 FROM b2 WHERE b IS NOT NULL),
al AS (SELECT video_id, max({{'d': d, 'n': -pos, 'p1': p1, 'p0': p0}}) AS x FROM d2 GROUP BY 1),
rk AS (SELECT video_id, x.d / 3 + CASE WHEN starts_with(video_id, 'L') THEN 0.02 ELSE 0 END AS score, x.p0 AS p0, x.p1 AS p1, -x.n AS p2 FROM al ORDER BY score DESC, video_id LIMIT {ANSWERS})
SELECT rk.video_id, round(score, 6) AS score, CAST(a.frame_id AS VARCHAR) || ',' || CAST(b.frame_id AS VARCHAR) || ',' || CAST(c.frame_id AS VARCHAR) AS frames
FROM rk JOIN fp a ON a.video_id = rk.video_id AND a.pos = p0 JOIN fp b ON b.video_id = rk.video_id AND b.pos = p1 JOIN fp c ON c.video_id = rk.video_id AND c.pos = p2"""

#: Planned queries of the transcript search, as words of speech, and key words of its events.
PLANNED, KEY_WORDS = ("bến phà", "red lighthouse"), ("ben", "pha", "red", "lighthouse")


def task_notebook(s, d):
    out = notebook(lexical.segments(s, d), lexical.speech_index(s, d), [speech_words(q) for q in PLANNED], KEY_WORDS)
    return out.select("video_id", F.round("score", 6).alias("score"), "n", "start", "text")


def _notebook_sql() -> str:
    terms = " UNION ALL ".join(f"SELECT {i} AS query_id, '{t}' AS term" for i, q in enumerate(PLANNED) for t in speech_words(q))
    covered = " + ".join(f"max(CASE WHEN contains({FOLD_SQL.format('text')}, '{c}') THEN 1 ELSE 0 END)" for c in KEY_WORDS)
    return lexical._SEG + f""", d AS (SELECT video_id || ':' || seg_idx AS key, {SPEECH_SQL.format('context')} AS words FROM ct), st AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM d),
tf AS (SELECT key, dl, term, count(*) AS tf FROM (SELECT key, len(words) AS dl, unnest(words) AS term FROM d) GROUP BY ALL),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st),
idf AS (SELECT term, CASE WHEN idf < 0 THEN greatest(0.25 * (SELECT avg(idf) FROM raw), 1e-9) ELSE idf END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM ({terms}) GROUP BY 1, 2),
sc AS (SELECT query_id, key, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term), st GROUP BY 1, 2),
h AS (SELECT key, max(score) AS score FROM (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) <= 10) GROUP BY 1 ORDER BY score DESC, key LIMIT 100),
m AS (SELECT video_id, seg_idx, start, score AS b, text FROM sg JOIN h ON h.key = video_id || ':' || seg_idx),
gp AS (SELECT *, lead(start) OVER (PARTITION BY video_id ORDER BY start NULLS FIRST, seg_idx) - start AS gap FROM m),
e AS (SELECT video_id, count(*) AS n, avg(b) AS bm, coalesce(exp(-pow(avg(gap), 2) / 1800.0), 1.0) AS g, ({covered}) / {float(len(KEY_WORDS))} AS cov, arg_max({{'s': start, 't': text}}, {{'b': b, 'i': -seg_idx}}) AS x FROM gp GROUP BY 1),
z AS (SELECT *, CASE WHEN max(bm) OVER () - min(bm) OVER () < 1e-9 THEN 0.0 ELSE (bm - min(bm) OVER ()) / (max(bm) OVER () - min(bm) OVER ()) END AS asr FROM e)
SELECT video_id, round(greatest(0.0, least(1.0, 0.35 * asr + 0.25 * cov + 0.15 * g)), 6) AS score, n, x.s AS start, x.t AS text FROM z ORDER BY round(greatest(0.0, least(1.0, 0.35 * asr + 0.25 * cov + 0.15 * g)), 9) DESC, video_id LIMIT 5"""


QUERIES = {f.__name__: f for f in (hybrid_rrf, task_kis, task_qa, task_trake, task_notebook)}
SQL = {
    "hybrid_rrf": _hybrid_sql() + " SELECT query_id, vector_id, round(score, 9) AS score FROM hy",
    "task_kis": _KIS_SQL + " SELECT query_id, video_id, frame_id, round(score, 6) AS score, rank FROM ki",
    "task_qa": _KIS_SQL + f""", fi AS (SELECT query_id, video_id FROM ki GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) <= 10),
an AS (SELECT video_id, arg_max(answer, {{'n': n, 'a': answer}}) AS answer FROM (SELECT {VIDEO_KEY_SQL.format('video_id')} AS video_id, answer, count(*) AS n FROM (SELECT video_id, unnest(object_labels) AS answer FROM frames) GROUP BY 1, 2) GROUP BY 1)
SELECT query_id, video_id, frame_id, rank, answer FROM ki JOIN fi USING (query_id, video_id) LEFT JOIN an USING (video_id)""",
    "task_trake": _TRAKE_SQL,
    "task_notebook": _notebook_sql(),
}
#: Tasks by name.
TASKS = {"kis": kis, "qa": qa, "trake": trake, "notebook": notebook}


def task(name: str) -> Callable[..., DataFrame]:
    if name not in TASKS:
        raise KeyError(f"unknown task {name!r}; there are {', '.join(TASKS)}")
    return TASKS[name]
