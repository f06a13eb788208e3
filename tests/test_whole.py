"""Queries take every row: what a cut of ids, rows or dimensions would lose."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from compare import compare
from sparkmoment import registry
from sparkmoment.functions.keys import video_key
from sparkmoment.functions.text import fold
from sparkmoment.operators import evaluate as E, signals as S, vector as V
from sparkmoment.plans import catalog, search, tasks
from sparkmoment.tables import table

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_ann_recall_over_every_20th(spark):
    k = 20
    true = {(r.query_id, r.vector_id) for r in V.knn(search.frames(spark, SF), search.every_20th(spark, SF), k).collect()}
    got = {(r.query_id, r.vector_id) for r in registry.QUERIES["ann_every"](spark, SF).collect()}
    assert {q for q, _ in got} == {r.query_id for r in search.every_20th(spark, SF).collect()}
    assert len(got & true) / len(true) >= 0.9


EVERY = ["knn_every", "knn_videos_every", "knn_rows_every", "diversify_every", "per_video_every", "video_rerank_every", "rrf_two_every", "rrf_variants_every", "best_per_video_every", "event_blend_every", "maxsim_every"]


@pytest.mark.parametrize("name", EVERY)
def test_searches_run_for_every_20th(spark, name):
    got = {r.query_id for r in registry.QUERIES[name](spark, SF).select("query_id").distinct().collect()}
    assert got == set(range(0, 500, 20))
    ok, said = compare(spark, SF, name)
    assert ok, said


def test_feedback_terms_come_from_hits(spark):
    ok, said = compare(spark, SF, "feedback_terms_hits")
    assert ok, said


def test_task_trake_aligns_all_videos_within_its_defaults(spark):
    n = {r.video_id: r["count"] for r in tasks._frames(spark, LARGER).groupBy("video_id").count().collect()}
    long = {v for v, k in n.items() if k >= 3}  # three events in increasing order take three frames
    assert 10 < len(long) <= tasks.ANSWERS
    assert {r.video_id for r in registry.QUERIES["task_trake"](spark, LARGER).collect()} == long


def test_frame_dedup_takes_each_version_at_its_own_dimension(spark):
    m, dims = table(spark, SF, "manifest_siglip2"), {r.embedding_version: r.embedding_dim for r in table(spark, SF, "siglip2_meta").collect()}
    f = table(spark, SF, "frames").select("vector_id", video_key("video_id").alias("v"), "timestamp", "source")
    rows = [r for r in f.join(m.select("vector_id", "embedding_version", "vec"), "vector_id").collect() if r.vec is not None and len(r.vec) == dims[r.embedding_version]]
    rows = [r for r in rows if None not in r.vec and np.isfinite(r.vec).all() and r.timestamp is not None and not np.isnan(r.timestamp)]
    kept, want = {}, set()
    for r in sorted(rows, key=lambda r: (r.timestamp, r.vector_id)):
        x = np.array(r.vec, float) / max(np.linalg.norm(r.vec), 1e-12)
        before = kept.setdefault((r.embedding_version, r.v), [])
        if not any(r.timestamp - t <= 0.5 and y @ x >= 0.98 and (own or r.source != "btc") for t, y, own in before):
            before.append((r.timestamp, x, r.source == "btc"))
            want.add(r.vector_id)
    assert {r.vector_id for r in registry.QUERIES["frame_dedup"](spark, SF).collect()} == want
    assert {r.embedding_version for r in rows if r.vector_id in want} == set(dims)


@pytest.mark.parametrize("name", ["speech_term_frames", "speech_interval_frames", "catalog_upsert_batches"])
def test_every_frame_takes_part(spark, name):
    ok, said = compare(spark, SF, name)
    assert ok, said
    got = registry.QUERIES[name](spark, SF).select("vector_id").collect()
    f = table(spark, SF, "frames").select("vector_id", video_key("video_id").alias("v"), "frame_id")
    if name == "catalog_upsert_batches":
        assert len(got) == f.select("v", "frame_id").distinct().count()
    else:
        scored = f.join(spark.createDataFrame(got), "vector_id")
        assert len(got) > 0 and {r.m for r in scored.select((scored.vector_id % 6).alias("m")).distinct().collect()} == set(range(6))


def test_a_hit_is_within_50_frames(spark):
    far = E.recalls(catalog._judged(spark, LARGER, 50_000), "query_id").agg({"r100": "sum"}).first()[0]
    near = registry.QUERIES["eval_recall_frames"](spark, LARGER).agg({"r100": "sum"}).first()[0]
    assert near < far
    for name in ("eval_recall_frames", "eval_ap_frames"):
        ok, said = compare(spark, LARGER, name)
        assert ok, said


def test_any_word_of_an_event_covers_it(spark):
    ok, said = compare(spark, SF, "event_coverage_words")
    assert ok, said
    e = table(spark, SF, "notebook_events").select("query_id", "event_index", F.regexp_extract(fold(F.col("vi_text")), "([a-z]{4,})", 1).alias("word"), "importance")
    m = table(spark, SF, "segment_matches").select("query_id", video_key("video_id").alias("video_id"), fold(F.col("segment_text")).alias("folded"))
    first = S.event_coverage(m, e.filter("word <> '' and importance is not null")).agg({"matched": "sum"}).first()[0]
    assert registry.QUERIES["event_coverage_words"](spark, SF).agg({"matched": "sum"}).first()[0] > (first or 0)


def test_more_queries_than_are_sent_at_once(spark):
    q = spark.range(12_000).selectExpr("id as query_id", "array(cast(cos(id) as double), cast(sin(id) as double)) as qvec")
    f = spark.range(5).selectExpr("id as vector_id", "'v' as video_id", "array(cast(cos(id) as double), cast(sin(id) as double)) as vec")
    assert q.count() > V.QUERY_BLOCK
    got = V.knn(f, q, 1)
    assert got.count() == 12_000
    assert {r.vector_id for r in got.filter("query_id < 5 and query_id = vector_id").collect()} == set(range(5))
