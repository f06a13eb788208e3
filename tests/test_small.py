"""Small functions on known values, and running operators whose groups are hot against plain Python."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkmoment import skew
from sparkmoment.functions.text import has_word, speech_tokens, speech_words
from sparkmoment.operators import align as A, catalog as C, lexical as L, orphans as OR, ranking as R, ranks, signals as S, vector as V
from sparkmoment.plans import tasks
from sparkmoment.sources import files
from sparkmoment.streaming import jobs


@pytest.fixture(params=[False, True])
def split(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(skew.hot_keys, "__defaults__", (4,))


def value(spark, c):
    return spark.range(1).select(c).first()[0]


def test_scores_and_keys(spark):
    assert [round(value(spark, S.verified(F.lit(1.0), F.lit(n))), 1) for n in (0, 1, 2, 5)] == [1.0, 0.7, 0.3, 0.3]
    assert value(spark, S.hue_between(F.lit(350), 340, 20)) and value(spark, S.hue_between(F.lit(10), 340, 20)) and not value(spark, S.hue_between(F.lit(30), 340, 20)) and value(spark, S.hue_between(F.lit(30), 20, 40))
    a, b = (value(spark, S.request_key(F.lit(x).alias("q"), F.lit(1).alias("k"))) for x in ("x", "y"))
    assert a != b and len(a) == 64 and a == value(spark, S.request_key(F.lit("x").alias("q"), F.lit(1).alias("k")))
    assert value(spark, has_word(F.array(F.lit("red"), F.lit("car")), "car")) and not value(spark, has_word(F.array(F.lit("cars")), "car"))
    assert [R.dynamic_k(n) for n in (0, 5, 100, 10_000)] == [1, 1, 20, 60]
    assert [A.decay_from_wording(t) for t in ("ngay sau đó", "much later", "then he", "x")] == [0.05, 0.002, 0.01, 0.01]
    assert value(spark, A.window_frames(F.array(F.lit(5)), 3, 2, F.lit(7))) == [2, 4, 5, 6, 7]
    with pytest.raises(KeyError, match="unknown task"):
        tasks.task("x")


@pytest.mark.parametrize("text", ["Luân Đôn, gi gh!", "London  PHO", "", "Đường ngh 12 luandon"])
def test_speech_words_on_both_sides(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(speech_tokens(F.col("t"))).first()[0] == speech_words(text)


def test_speech_forms():
    assert speech_words("luân đôm và London gi") == ["london", "va", "london", "di"]


def test_detector_files_and_dev_sets(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.json").write_text(json.dumps({"detection_class_entities": ["Car"], "detection_scores": ["0.5"], "detection_boxes": [[0, 0, 1, 1]]}))
    (tmp_path / "d" / "2.json").write_text("{no")
    got = {r.path[-6:]: (r.entities, r.scores) for r in files.read_detections(spark, str(tmp_path / "d")).collect()}
    assert got == {"1.json": (["Car"], ["0.5"]), "2.json": (None, None)}
    (tmp_path / "dev.jsonl").write_text('{"query": "a", "gt_video_id": "v", "gt_frame_id": 3}\n{"query": "b"}\n')
    assert [tuple(r) for r in files.read_dev_set(spark, str(tmp_path / "dev.jsonl")).collect()] == [("a", "v", 3)]
    assert files.read_dev_set(spark, str(tmp_path / "none.jsonl")).collect() == []


def test_counts_of_a_stream(spark, tmp_path):
    at = datetime.datetime(2025, 1, 1)
    rows = [(at + datetime.timedelta(minutes=10 * k), "a" if k % 2 else "b") for k in range(9)]
    spark.createDataFrame(rows, "ts timestamp, k string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/in")
    q = jobs.counts_stream(stream, ["k"], late="0 seconds").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.start.hour, r.k, r.n) for r in spark.table("counted").collect()) == [(0, "a", 3), (0, "b", 3), (1, "a", 1), (1, "b", 2)]


def _times(seed=1, n=300):
    r = random.Random(seed)
    return [(i, r.choice("aaaaab"), r.choice([None, float(r.randrange(200)) / 4]), r.choice([None, 1, 2, 3]), float(r.randrange(50))) for i in range(n)]


def test_carried_values_and_places(spark, split):
    rows = [x for x in _times() if x[2] is not None]
    df = spark.createDataFrame(rows, "i bigint, k string, t double, v int, s double")
    last, place = {}, {}
    state, n = {}, {}
    want_last, want_before = {}, {}
    for i, k, t, v, _ in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        want_before[i] = state.get(k)
        state[k] = v if v is not None else state.get(k)
        want_last[i], place[i] = state[k], n.get(k, 0)
        n[k] = n.get(k, 0) + 1
    assert {r.i: r.o for r in skew.grouped_last(df, ["k"], "t", ["i"], "v", "o").collect()} == want_last
    assert {r.i: r.o for r in skew.grouped_last(df, ["k"], "t", ["i"], "v", "o", own=False).collect()} == want_before
    assert {r.i: r.o for r in skew.grouped_places(df, ["k"], "t", ["i"], "o").collect()} == place


def test_moments_kept_together_by_shots(spark, split):
    rows = [x for x in _times(2) if x[2] is not None]
    df = spark.createDataFrame([(i, k, t * 3, v, s) for i, k, t, v, s in rows], "vector_id bigint, video_id string, timestamp double, shot_id bigint, score double")
    want, now = {}, {}
    for i, k, t, v, s in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        t *= 3
        m = now.get(k)
        if m is None or not (t - m[1] <= 3 or (m[2] is not None and m[2] == v)):
            m = now[k] = [m[0] + 1 if m else 0, t, v]
        elif t - m[1] > 3:
            m[2] = v
        m[1] = t
        want.setdefault((k, m[0]), []).append(t)
    got = {(r.video_id, r.moment): (r.n, r.start, r.end) for r in R.moments_with_shots(df, 3.0).collect()}
    assert got == {k: (len(x), min(x), max(x)) for k, x in want.items()}


def test_greedy_picks(spark):
    rows = _times(3)
    df = spark.createDataFrame([(i, k, t, None if v is None else s) for i, k, t, v, s in rows], "i bigint, k string, t double, s double")
    want = {}
    for i, k, t, v, s in sorted((x for x in rows if x[2] is not None), key=lambda x: (x[3] is None, -x[4] if x[3] is not None else 0, x[2], x[0])):
        p = want.setdefault(k, [])
        if len(p) < 5 and all(abs(t - x) >= 4 for x in p):
            p.append(t)
    assert {r.k: r.times for r in C.spaced(df, ["k"], "t", "s", "i", 4.0, 5).collect()} == {k: sorted(p) for k, p in want.items()}
    assert C.spaced(df.limit(0), ["k"], "t", "s", "i", 4.0, 5).collect() == []


def test_narrowest_of_long_and_endless_intervals(spark):
    inf = float("inf")
    i = spark.createDataFrame([("v", 1, 0.0, 1e9), ("v", 2, 10.0, 20.0), ("v", 3, 15.0, 15.0), ("v", 4, -inf, inf), ("v", 5, 10.0, 20.0), ("v", 6, 30.0, 25.0), ("v", 7, None, 9.0)], "video_id string, shot_id int, s double, e double")
    p = spark.createDataFrame([("v", 1, 15.0), ("v", 2, 12.0), ("v", 3, 5e8), ("v", 4, -1.0), ("v", 5, float("nan")), ("w", 6, 1.0)], "video_id string, point_id int, t double")
    assert {r.point_id: r.shot_id for r in C.narrowest_interval(p, i).collect()} == {1: 3, 2: 2, 3: 1}


def test_values_between_places(spark, split):
    df = spark.createDataFrame([("a", float(x)) for x in range(101)] + [("b", 5.0), ("b", None), ("c", None)], "k string, x double")
    got = {r.k: (r.n, r.m, r.p) for r in ranks.values_at(df, ["k"], "x", {"m": lambda n: (n - 1) * F.lit(0.5), "p": lambda n: n * F.lit(2.0)}).collect()}
    assert got == {"a": (101, 50.0, 100.0), "b": (1, 5.0, 5.0)}


def test_pooling_of_hot_and_mixed_keys(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 2.0]), (None, 3, [3.0, 4.0]), ("b", 4, None), ("c", 5, [1.0, 0.0, 0.0]), ("c", 6, [0.0, 1.0])] + [("h", 10 + i, [1.0, float(i)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, vector_id int, vec array<float>").repartition(5)
    got = {(r.k, len(r.vec)): [round(x, 5) for x in r.vec] for r in V.mean_pool(df, ["k"]).collect()}
    n = (1 + 99.5**2) ** 0.5
    assert got == {("a", 2): [0.44721, 0.89443], (None, 2): [0.6, 0.8], ("c", 3): [1.0, 0.0, 0.0], ("c", 2): [0.0, 1.0], ("h", 2): [round(1 / n, 5), round(99.5 / n, 5)]}
    assert V.mean_pool(df.limit(0), ["k"]).collect() == []
    assert {r.k: [round(x, 4) for x in r.vec] for r in V.max_pool(df.filter("k = 'a'"), ["k"]).collect()} == {"a": [0.4472, 0.8944]}


def test_orphans_along_a_chain_that_refers_to_itself(spark):
    n = 14
    rows = spark.createDataFrame([(i, i - 1 if i else 99, datetime.datetime(2025, 1, 1)) for i in range(n)], "id bigint, up bigint, at timestamp_ntz")
    e = {"t": OR.Entity(rows, "id", "at", F.col("id"), "at")}
    got = {r.child_id: (r.kind, r.depth) for r in OR.orphan_cascade(e, [OR.Reference("t", "t", "t.up", F.col("up"))]).collect()}
    assert got == {0: ("missing", 0)} | {i: ("inherited", i) for i in range(1, n)}


def test_scores_of_what_is_said_around(spark, split):
    r = random.Random(5)
    segs = [("v" if r.random() < 0.9 else "w", float(r.randrange(300)), r.choice(["red boat", "red", "x"])) for _ in range(60)]
    segs = [(v, s, s + r.choice([0.0, 3.0, 60.0]), t) for v, s, t in segs]
    cand = [(i, r.choice("vvw"), float(r.randrange(320))) for i in range(80)]
    S_ = spark.createDataFrame(segs, "video_id string, start double, end double, folded string")
    C_ = spark.createDataFrame(cand, "vector_id bigint, video_id string, timestamp double")
    import math

    want = {}
    for i, v, t in cand:
        for w, a, b, text in segs:
            share = sum(x in text for x in ("red", "boat")) / 2
            if v == w and share:
                s = share * max(0.1, math.exp(-0.01 * abs(t - (a + b) / 2))) * (1.0 if a - 2 <= t <= b + 2 else 0.3)
                want[i] = max(want.get(i, 0), s)
    got = {x.vector_id: x.score for x in L.interval_scores(C_, S_, ["red", "boat"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
