"""Many searches: blocks of queries that each meet all rows find what few of them do."""

import pytest
from pyspark.sql import functions as F

from compare import compare
from sparkmoment.operators import lexical as L, vector as V
from sparkmoment.plans import search, tasks

SF = "/root/testdata/sf0.01"


def _plain(df):
    return sorted((str(r.query_id), r["rank"], r[1], round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("k", [0, 1, 7, 100_000])
def test_knn_in_blocks_is_knn(spark, monkeypatch, k):
    monkeypatch.setattr("sparkmoment.operators.blocks.CHUNK", 100)
    f, q = search.frames(spark, SF), search.every_20th(spark, SF)
    q = q.withColumn("query_id", F.struct("query_id", F.lit("a").alias("v")))
    want = _plain(V.knn(f, q, k))
    assert _plain(V.knn(f, q, k, few=3, block=4)) == want


def test_knn_in_blocks_takes_equals_by_id_and_other_lengths(spark, monkeypatch):
    monkeypatch.setattr("sparkmoment.operators.blocks.CHUNK", 10)
    vec = F.when(F.col("id") % 7 == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).when(F.col("id") % 11 != 0, F.array(F.lit(1.0), F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise((F.col("id") % 3).cast("double"))))
    f = spark.range(500).select(F.concat(F.lit("i"), (F.col("id") * 7919 % 500).cast("string")).alias("vector_id"), F.lit("v").alias("video_id"), vec.alias("vec"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 2.0]), (3, [0.0, 0.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0])], "query_id bigint, qvec array<double>")
    want = _plain(V.knn(f, q, 20))
    assert len(want) == 80 and _plain(V.knn(f, q, 20, few=1)) == want


@pytest.mark.parametrize("k", [1, 5, 10_000])
def test_bm25_in_blocks_is_bm25(spark, monkeypatch, k):
    monkeypatch.setattr("sparkmoment.operators.blocks.CHUNK", 50)
    frames = tasks._frames(spark, SF)
    index = L.bm25_index(frames, "vector_id", tasks.tokens(F.col("text")))
    _, terms, _ = tasks._searches(frames)
    terms = terms.unionByName(terms.limit(5)).unionByName(spark.createDataFrame([(-1, "none"), (None, "person"), (-2, "person"), (-2, "none")], "query_id bigint, term string"))
    want = _plain(L.bm25_search(index, terms, k, few=10**6))
    assert want and _plain(L.bm25_search(index, terms, k, few=0, block=4)) == want


@pytest.mark.parametrize("name", ["hybrid_rrf", "task_kis", "task_qa"])
def test_tasks_in_blocks_are_sql(spark, monkeypatch, name):
    monkeypatch.setattr(V.knn, "__defaults__", (3, 4))
    monkeypatch.setattr(L.bm25_search, "__defaults__", (3, 4))
    ok, said = compare(spark, SF, name)
    assert ok, said


def test_many_searches_pair_nothing_with_every_row(spark):
    """12,000 searches of 3,000 vectors: the k best leave the tasks that compared them, and no join makes the pairs."""
    vec = lambda c: F.array(F.cos(c * 1.0), F.sin(c * 1.0))
    q = spark.range(12_000).select(F.col("id").alias("query_id"), vec(F.col("id")).alias("qvec"))
    f = spark.range(3_000).select(F.col("id").alias("vector_id"), F.lit("v").alias("video_id"), vec(F.col("id")).alias("vec"))
    hits = V.knn(f, q, 5)
    assert "Join" not in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == 60_000


def test_kis_ranks_a_search_where_its_rows_lie(spark):
    frames = spark.range(60).select(F.col("id").alias("vector_id"), F.concat(F.lit("V"), (F.col("id") % 3).cast("string")).alias("video_id"), (F.col("id") % 20).alias("frame_id"), F.array(F.lit("car")).alias("labels"))
    fused = spark.range(120).select((F.col("id") % 2).alias("query_id"), (F.col("id") % 60).alias("vector_id"), (1 / (F.col("id") + 1)).alias("score"))
    out = tasks.kis(frames, fused, answers=10, per_video=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(query_id" in line]
    assert len(moved) == 1 and "video_id" not in moved[0]
    assert [r["rank"] for r in out.filter("query_id = 1").orderBy("rank").collect()] == list(range(1, 11))


def test_qa_finds_its_candidates_once(spark):
    looked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            looked.add(len(b))
            yield b

    c = spark.range(40).select((F.col("id") % 2).alias("query_id"), F.concat(F.lit("V"), (F.col("id") % 5).cast("string")).alias("video_id"), F.col("id").alias("vector_id"), F.col("id").alias("rank"))
    c = c.mapInArrow(counted, c.schema)
    got = tasks.qa(c, lambda rows: rows.select("query_id", "video_id", F.lit("a").alias("answer")), 3).collect()
    assert len(got) == 24 and {r.answer for r in got} == {"a"}
    assert looked.value == 40
