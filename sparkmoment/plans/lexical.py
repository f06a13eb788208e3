"""Queries of lexical search and transcript evidence over ``documents``, ``asr_sidecar`` and ``segment_matches``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession, functions as F

from ..functions.keys import VIDEO_KEY_SQL, video_key
from ..functions.text import FOLD_SQL, NORMALIZE_SQL, SPEECH_SQL, TOKENS_SQL, fold, format_timestamp, nfc, normalize_answer, speech_tokens, speech_words, tokens
from ..operators import lexical as L, ranking as R
from ..store import present
from ..tables import table

QUERIES, SQL = {}, {}
TERMS = ["the", "lighthouse", "red", "bến", "phà"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "lang", "source")


def segments(s, d):
    """Transcript segments; each record is a video of its own."""
    x = table(s, d, "asr_sidecar").select(F.concat(F.lit("R"), F.col("record_id").cast("string")).alias("video_id"), F.posexplode("segments").alias("seg_idx", "g"))
    return x.select("video_id", "seg_idx", F.col("g.text").alias("text"), F.col("g.start").alias("start"), F.col("g.end").alias("end"), F.col("g.frame").alias("frame"))


_TOK = TOKENS_SQL.format("text")
#: Indexes of this session, by application, folder and name: built by the first search that needs them.
_INDEXES: dict[tuple[str, str, str], L.Bm25] = {}


def indexed(s: SparkSession, d: str, name: str, build: Callable[[], L.Bm25]) -> L.Bm25:
    key = (s.sparkContext.applicationId, d, name)
    if key not in _INDEXES or not present(_INDEXES[key].postings):
        _INDEXES[key] = build()
    return _INDEXES[key]


def docs_index(s, d) -> L.Bm25:
    return indexed(s, d, "documents", lambda: L.bm25_index(docs(s, d), "doc_id", tokens(F.col("text"))))


def speech_index(s, d) -> L.Bm25:
    """Transcript segments with their neighbours, by their words as speech recognition may have spelt them."""
    def build() -> L.Bm25:
        c = L.with_context(segments(s, d)).select(F.concat_ws(":", "video_id", "seg_idx").alias("key"), "context")
        return L.bm25_index(c, "key", speech_tokens(F.col("context")))

    return indexed(s, d, "speech", build)


def _bm25_sql(source: str, key: str, terms: list[str], words: str = _TOK) -> str:
    times = " ".join(f"WHEN '{t}' THEN {terms.count(t)}" for t in sorted(set(terms)))
    listed = ", ".join(f"'{t}'" for t in sorted(set(terms)))
    return f"""WITH d AS (SELECT {key} AS key, {words} AS words FROM {source}),
st AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM d),
x AS (SELECT key, len(words) AS dl, unnest(words) AS term FROM d), tf AS (SELECT key, dl, term, count(*) AS tf FROM x GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfs, st),
idf AS (SELECT term, df, CASE WHEN idf < 0 THEN greatest(0.25 * (SELECT avg(idf) FROM raw), 1e-9) ELSE idf END AS idf FROM raw),
sc AS (SELECT key, sum(CASE term {times} ELSE 0 END * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN idf USING (term), st WHERE term IN ({listed}) GROUP BY 1)
"""


@query(_bm25_sql("documents", "doc_id", TERMS) + "SELECT key AS doc_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY score DESC, key LIMIT 100")
def bm25_search(s, d):
    """The best 100 texts for the terms, from an index that is built once."""
    return L.bm25_search(docs_index(s, d), L.one_query(s, TERMS), 100).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_bm25_sql("documents", "doc_id", TERMS) + "SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")
def bm25_idf_table(s, d):
    return docs_index(s, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


_GROUPS = [["red", "lighthouse"], ["bến", "phà"]]


@query(f"WITH d AS (SELECT doc_id, {_TOK} AS w FROM documents) SELECT doc_id FROM d WHERE list_has_all(w, ['red', 'lighthouse']) OR list_has_all(w, ['bến', 'phà'])")
def postings_and_or(s, d):
    return L.any_group_of_all(L.postings(docs(s, d), "doc_id", "text"), "doc_id", _GROUPS)


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct({_TOK})) AS token FROM documents) GROUP BY 1")
def token_postings(s, d):
    return L.postings(docs(s, d), "doc_id", "text").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, array_to_string({}, ' ') AS words FROM documents".format(TOKENS_SQL.format("nfc_normalize(text)")))
def tokenize(s, d):
    return docs(s, d).select("doc_id", F.array_join(tokens(nfc(F.col("text"))), " ").alias("words"))


@query("SELECT doc_id, {} AS folded FROM documents".format(FOLD_SQL.format("text")))
def text_fold(s, d):
    return docs(s, d).select("doc_id", fold(F.col("text")).alias("folded"))


@query(f"""WITH m AS (SELECT doc_id, {FOLD_SQL.format('text')} AS t FROM documents), h AS (SELECT doc_id, t LIKE '%lighthouse%' OR t LIKE '%pha %' AS hit FROM m)
SELECT doc_id FROM h WHERE hit OR NOT (SELECT coalesce(bool_or(hit), false) FROM h)""")
def metadata_filter(s, d):
    """Documents with any folded term as a substring; all of them when none has."""
    rows = docs(s, d).select("doc_id", fold(F.col("text")).alias("t"))
    rows = rows.withColumn("hit", F.coalesce(F.contains("t", F.lit("lighthouse")) | F.contains("t", F.lit("pha ")), F.lit(False)))
    some = rows.agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("some"))
    return rows.crossJoin(F.broadcast(some)).filter("hit or not some").select("doc_id")


@query("SELECT doc_id FROM documents WHERE starts_with(source, 'no') OR starts_with(source, 'ca')")
def prefix_filter(s, d):
    c = F.col("source")
    return docs(s, d).filter(c.startswith("no") | c.startswith("ca")).select("doc_id")


@query(f"""WITH t AS (SELECT doc_id, {FOLD_SQL.format('text')} AS f FROM documents)
SELECT doc_id, round(0.2 * (CAST(coalesce(contains(f, 'red'), false) AS INT) + CAST(coalesce(contains(f, 'thuyen'), false) AS INT) + CAST(coalesce(contains(f, 'bridge'), false) AS INT)) / 3.0, 6) AS bonus FROM t""")
def metadata_bonus(s, d):
    """0.2 times the share of the folded query terms found as substrings."""
    rows = docs(s, d).select("doc_id", F.coalesce(fold(F.col("text")), F.lit("")).alias("f"))
    return rows.select("doc_id", F.round(0.2 * L.term_share(F.col("f"), ["red", "thuyen", "bridge"]), 6).alias("bonus"))


_COLOURS = ["red", "blue", "green", "white", "yellow", "black"]


@query("WITH w AS (SELECT doc_id, {} AS w FROM documents) SELECT doc_id, array_to_string(list_sort(list_intersect(list_distinct(w), ['red', 'blue', 'green', 'white', 'yellow', 'black'])), ',') AS colours FROM w".format(_TOK))
def colour_words(s, d):
    have = F.array_sort(F.array_intersect(F.array(*map(F.lit, _COLOURS)), tokens(F.col("text"))))
    return docs(s, d).select("doc_id", F.array_join(have, ",").alias("colours"))


_SEG = """WITH sg AS (SELECT 'R' || record_id AS video_id, i - 1 AS seg_idx, segments[i].text AS text, segments[i].start AS start, segments[i]."end" AS e, segments[i].frame AS frame FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS i FROM asr_sidecar)),
cx AS (SELECT *, lag(text) OVER w AS p, lead(text) OVER w AS n FROM sg WINDOW w AS (PARTITION BY video_id ORDER BY seg_idx)),
ct AS (SELECT *, array_to_string(list_filter([p, text, n], lambda t: t IS NOT NULL AND regexp_matches(t, '[^\\s\\p{Z}]')), ' ') AS context FROM cx)
"""


@query(_SEG + "SELECT video_id, CAST(seg_idx AS BIGINT) AS seg_idx, context FROM ct")
def speech_context(s, d):
    return L.with_context(segments(s, d)).select("video_id", F.col("seg_idx").cast("bigint").alias("seg_idx"), "context")


_SPEECH_TERMS = ["luân", "đôn", "red", "lighthouse", "phà", "gi"]


@query(_SEG + "," + _bm25_sql("(SELECT video_id || ':' || seg_idx AS k, context AS text FROM ct)", "k", speech_words(" ".join(_SPEECH_TERMS)), SPEECH_SQL.format("text"))[5:] + "SELECT key, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY score DESC, key LIMIT 30")
def speech_bm25(s, d):
    """Transcript search over segments with their neighbours, by words as speech recognition may have spelt them."""
    terms = speech_words(" ".join(_SPEECH_TERMS))
    return L.bm25_search(speech_index(s, d), L.one_query(s, terms), 30).select("key", F.round("score", 6).alias("score"))


@query("SELECT record_id, array_to_string({}, ' ') AS words FROM asr_sidecar".format(SPEECH_SQL.format("text")))
def speech_words_table(s, d):
    return table(s, d, "asr_sidecar").select("record_id", F.array_join(speech_tokens(F.col("text")), " ").alias("words"))


_WORDS = ["hang", "red", "ben"]
_SHARE = "(" + " + ".join(f"CAST(contains(folded, '{w}') AS INT)" for w in _WORDS) + ") / 3.0"
_K = VIDEO_KEY_SQL.format("video_id")
_FRM = f"""WITH sg AS (SELECT {_K} AS video_id, u.text AS text, u.start AS start, u."end" AS e, u.frame AS frame FROM (SELECT video_id, unnest(segments) AS u FROM asr_sidecar)),
fo AS (SELECT *, {FOLD_SQL.format("coalesce(text, '')")} AS folded FROM sg), sh AS (SELECT *, {_SHARE} AS share FROM fo), v AS (SELECT {_K} AS k, fps FROM videos),
cand AS (SELECT vector_id, k2 AS video_id, CASE WHEN frame_unit = 'ms' THEN CASE WHEN fps > 0 THEN CAST(round_even(greatest(frame_id / 1000.0, 0) * fps, 0) AS BIGINT) END ELSE frame_id END AS frame_id,
CASE WHEN frame_unit = 'ms' THEN frame_id / 1000.0 ELSE coalesce("timestamp", CASE WHEN fps > 0 THEN frame_id / fps END) END AS t FROM (SELECT *, {_K} AS k2 FROM frames) LEFT JOIN v ON k = k2)
"""


def _frames_said(s, d):
    """Every frame with its number and time, and every segment, by video."""
    v = table(s, d, "videos").select(video_key("video_id").alias("video_id"), "fps")
    f = table(s, d, "frames").select("vector_id", video_key("video_id").alias("video_id"), "frame_id", "frame_unit", "timestamp").join(v, "video_id", "left")
    ms, known = F.coalesce(F.col("frame_unit") == "ms", F.lit(False)), F.when(F.col("fps") > 0, F.col("fps"))
    number = F.when(ms, F.bround(F.greatest(F.col("frame_id") / 1000.0, F.lit(0.0)) * known).cast("bigint")).otherwise(F.col("frame_id"))
    time = F.when(ms, F.col("frame_id") / 1000.0).otherwise(F.coalesce("timestamp", F.col("frame_id") / known))
    c = f.select("video_id", "vector_id", number.alias("frame_id"), time.alias("timestamp"))
    x = table(s, d, "asr_sidecar").select(video_key("video_id").alias("video_id"), F.explode("segments").alias("g")).select("video_id", F.col("g.start").alias("start"), F.col("g.end").alias("end"), F.col("g.frame").alias("frame"), fold(F.coalesce("g.text", F.lit(""))).alias("folded"))
    return c, x


@query(_FRM + "SELECT vector_id, round(max(share * greatest(0.3, 1 - abs(frame_id - frame) / 150.0)), 6) AS score FROM cand c JOIN sh ON sh.video_id = c.video_id AND abs(frame_id - frame) <= 150 AND share > 0 GROUP BY 1")
def speech_term_frames(s, d):
    """Every frame by what is said near it."""
    return L.near_segment_scores(*_frames_said(s, d), _WORDS).select("vector_id", F.round("score", 6).alias("score"))


@query(_FRM + """SELECT vector_id, round(max(share * greatest(0.1, exp(-0.01 * abs(t - (start + e) / 2))) * CASE WHEN t >= start - 2 AND t <= e + 2 THEN 1.0 ELSE 0.3 END), 6) AS score
FROM cand c JOIN sh ON sh.video_id = c.video_id AND share > 0 WHERE isfinite(t) AND isfinite(start) AND isfinite(e) GROUP BY 1""")
def speech_interval_frames(s, d):
    """Every frame with a time by what is said around it in its video."""
    c, x = _frames_said(s, d)
    ok = lambda k: F.col(k).isNotNull() & (F.abs(F.col(k)) < float("inf"))
    return L.interval_scores(c.filter(ok("timestamp")), x.filter(ok("start") & ok("end")), _WORDS).select("vector_id", F.round("score", 6).alias("score"))


_EV = f"""WITH m AS (SELECT match_id, query_id, {_K} AS video_id, start, bm25_score, dense_score FROM segment_matches WHERE start IS NOT NULL),
g AS (SELECT *, lead(start) OVER (PARTITION BY query_id, video_id ORDER BY start, match_id) - start AS gap FROM m),
ev AS (SELECT query_id, video_id, count(*) AS n, avg(bm25_score) AS bm25, coalesce(avg(CASE WHEN dense_score > 0 THEN dense_score END), 0) AS dense, coalesce(exp(-pow(avg(gap), 2) / 1800.0), 1.0) AS gap FROM g GROUP BY 1, 2)
"""


def _matches(s, d):
    return table(s, d, "segment_matches").select("match_id", "query_id", video_key("video_id").alias("video_id"), "start", "bm25_score", "dense_score").filter("start is not null")


@query(_EV + "SELECT query_id, video_id, n, round(bm25, 6) AS bm25, round(dense, 6) AS dense, round(gap, 6) AS gap FROM ev")
def speech_evidence(s, d):
    return L.evidence(_matches(s, d)).select("query_id", "video_id", "n", *(F.round(c, 6).alias(c) for c in ("bm25", "dense", "gap")))


@query(_EV + """, z AS (SELECT *, CASE WHEN max(bm25) OVER w - min(bm25) OVER w < 1e-9 THEN 0.0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS asr FROM ev WINDOW w AS (PARTITION BY query_id))
SELECT query_id, video_id, round(greatest(0.0, least(1.0, 0.35 * asr + 0.15 * dense + 0.25 * least(1.0, n / 5.0) + 0.15 * gap)), 6) AS score FROM z""")
def speech_video_score(s, d):
    """Videos by their transcript evidence; the share of five matches plays the event coverage."""
    e = L.evidence(_matches(s, d))
    return L.video_scores(e, F.least(F.lit(1.0), F.col("n") / 5.0), F.lit(0.0)).select("query_id", "video_id", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE m AS (SELECT query_id, {_K} AS video_id, start AS t, row_number() OVER (PARTITION BY query_id, {_K} ORDER BY bm25_score DESC NULLS LAST, start, match_id) AS i FROM segment_matches WHERE start IS NOT NULL),
p AS (SELECT query_id, video_id, i, [t] AS picked FROM m WHERE i = 1 UNION ALL
  SELECT m.query_id, m.video_id, m.i, CASE WHEN len(picked) < 10 AND len(list_filter(picked, lambda x: abs(x - m.t) < 5)) = 0 THEN list_append(picked, m.t) ELSE picked END
  FROM p JOIN m ON m.query_id IS NOT DISTINCT FROM p.query_id AND m.video_id IS NOT DISTINCT FROM p.video_id AND m.i = p.i + 1)
SELECT query_id, video_id, array_to_string(list_transform(list_sort(arg_max(picked, i)), lambda x: CAST(x AS VARCHAR)), ',') AS times FROM p GROUP BY 1, 2""")
def speech_diverse_ts(s, d):
    return L.diverse_times(_matches(s, d)).select("query_id", "video_id", F.array_join(F.transform("times", lambda t: t.cast("string")), ",").alias("times"))


@query(_bm25_sql("documents", "doc_id", TERMS) + f""", h AS (SELECT key FROM sc WHERE score > 0 ORDER BY score DESC, key LIMIT 5), w AS (SELECT unnest({_TOK}) AS term FROM documents WHERE doc_id IN (SELECT key FROM h))
SELECT term, count(*) AS n FROM w WHERE length(term) >= 2 AND term NOT IN ('the', 'a', 'and', 'of', 'to', 'in') GROUP BY 1 ORDER BY n DESC, term LIMIT 3""")
def feedback_terms_hits(s, d):
    """Words for a second search from the five best hits of ``bm25_search``'s terms."""
    hits = L.bm25_search(docs_index(s, d), L.one_query(s, TERMS), 5).select(F.col("key").alias("doc_id"))
    return L.feedback_terms(docs(s, d).join(F.broadcast(hits), "doc_id", "left_semi"), "text", ["the", "a", "and", "of", "to", "in"])


@query("""WITH m AS (SELECT match_id, query_id, {k} AS video_id, start, "end" AS e, left(segment_text, 50) AS t, bm25_score AS b, dense_score AS x FROM segment_matches),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST, match_id) AS rank, 1 AS l FROM m), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC NULLS LAST, match_id) AS rank, 2 AS l FROM m WHERE x > 0),
u AS (SELECT * FROM a UNION ALL SELECT * FROM c)
SELECT query_id, video_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM u WHERE video_id IS NOT NULL GROUP BY query_id, video_id, start, e, t""".format(k=_K))
def fuse_bm25_dense(s, d):
    """Transcript matches fused by rank over (video, start, end, first 50 characters)."""
    from pyspark.sql import Window as W

    m = table(s, d, "segment_matches").select("match_id", "query_id", video_key("video_id").alias("video_id"), "start", "end", F.substring("segment_text", 1, 50).alias("t"), "bm25_score", "dense_score")
    by = lambda c: W.partitionBy("query_id").orderBy(F.desc_nulls_last(c), "match_id")
    one = m.withColumn("rank", F.row_number().over(by("bm25_score")))
    two = m.filter("dense_score > 0").withColumn("rank", F.row_number().over(by("dense_score")))
    lists = one.unionByName(two).filter("video_id is not null").select(F.struct("query_id", "video_id", "start", "end", "t").alias("id"), "rank", F.lit(1.0).alias("weight"))
    return R.rrf(lists).select("id.query_id", "id.video_id", F.round("score", 6).alias("score"))


@query("SELECT kis_id, {} AS answer FROM kis_dev".format(NORMALIZE_SQL.format("query")))
def normalize_answers(s, d):
    return table(s, d, "kis_dev").select("kis_id", normalize_answer(F.col("query")).alias("answer"))


@query("""WITH m AS (SELECT request_id, CAST(round_even(greatest(coalesce(requested_timestamp, 0), 0) * 1000, 0) AS BIGINT) AS ms FROM frame_requests)
SELECT request_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock FROM m""")
def format_timestamps(s, d):
    return table(s, d, "frame_requests").select("request_id", format_timestamp(F.col("requested_timestamp")).alias("clock"))
