"""Operators of the core against brute force, known results and hard cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkmoment import skew
from sparkmoment.functions.keys import millis, video_key
from sparkmoment.functions.text import fold, format_timestamp, tokens
from sparkmoment.operators import align as A, catalog as C, evaluate as E, intervals as I, lexical as L, objects as O, orphans as P, ranking as R
from sparkmoment.operators.ranks import places


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def hot(monkeypatch):
    """Makes small tables count as large, so that the ways for hot keys are taken."""
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (4,))


def test_video_key(spark):
    df = spark.createDataFrame([(" l0001-v002.MP4 ",), ("L0001 V002",), ("l0001_v002",), ("LO001_V002",), (None,)], "v string")
    assert [r[0] for r in df.select(video_key("v")).collect()] == ["L0001_V002"] * 3 + ["LO001_V002", None]


def test_millis(spark):
    df = spark.createDataFrame([(1.0004,), (2.0006,), (float("nan"),), (float("inf"),), (None,)], "s double")
    assert [r[0] for r in df.select(millis("s")).collect()] == [1000, 2001, None, None, None]


def test_salted_join_equals_join(spark, hot):
    r = random.Random(1)
    left = spark.createDataFrame([(i, None if r.random() < 0.1 else (7 if r.random() < 0.5 else r.randrange(20))) for i in range(400)], "id int, k int")
    right = spark.createDataFrame([(k, k * 10) for k in range(3, 15)] + [(7, 71), (None, 5)], "k int, v int")
    assert skew.hot_keys(left, ["k"])
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew.salted_join(left, right, ["k"], how, ["id"])) == rows(left.join(right, "k", how)), how


def test_grouped_cumsum_of_hot_group(spark, hot):
    r = random.Random(2)
    data = [("a" if r.random() < 0.7 else r.choice("bc"), i, r.randrange(5)) for i in r.sample(range(10_000), 500)]
    got = skew.grouped_cumsum(spark.createDataFrame(data, "k string, x bigint, n bigint"), ["k"], "x", F.col("n"), "upto").collect()
    for g in got:
        assert g.upto == sum(n for k, x, n in data if k == g.k and x <= g.x)


def test_islands_of_hot_group(spark, hot):
    r = random.Random(4)
    data = [("a" if r.random() < 0.7 else r.choice("bc"), i, float(r.randrange(0, 4000))) for i in range(500)]
    got = R.islands(spark.createDataFrame(data, "video_id string, vector_id int, timestamp double"), ["video_id"], "timestamp", 10.0).collect()
    last, no = {}, {}
    want = {}
    for v, i, t in sorted(data, key=lambda x: x[2]):
        no[v] = no.get(v, 0) + (v in last and t - last[v] > 10.0)
        last[v] = t
        want[i] = no[v]
    assert {x.vector_id: x.island for x in got} == want


def _union(iv):
    out = []
    for s, e in sorted(iv):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("split", [False, True])
def test_intervals_against_sweep(spark, split, request):
    if split:
        request.getfixturevalue("hot")
    r = random.Random(3)
    data = []
    for _ in range(600):
        s = r.randrange(0, 3000, 5)
        data.append((r.choice("aaaaab"), s, s + r.choice([-5, 0, 5, 10, 40])))
    data += [("a", None, 5), ("a", 5, None), ("c", 1, 1), ("d", 3, 9), ("d", 3, 9), (None, 1, 2)]
    df = spark.createDataFrame(data, "k string, s bigint, e bigint").withColumn("extra", F.lit(1))
    periods, gaps = [], []
    for k in {x[0] for x in data}:
        u = _union([(s, e) for kk, s, e in data if kk == k and s is not None and e is not None and e > s])
        periods += [(k, *x) for x in u]
        gaps += [(k, a[1], b[0]) for a, b in zip(u, u[1:])]
    assert rows(I.interval_gaps(df.filter("k is not null"), ["k"], "s", "e")) == sorted([g for g in gaps if g[0] is not None], key=repr)
    assert rows(I.interval_periods(df.filter("k is not null"), ["k"], "s", "e")) == sorted([p for p in periods if p[0] is not None], key=repr)
    assert I.interval_gaps(df.limit(0), ["k"], "s", "e").count() == 0


def _entities(spark, people):
    return {"p": P.Entity(spark.createDataFrame(people, "id bigint, boss bigint, born timestamp_ntz, gone timestamp_ntz, extra int"), "id", "born", F.col("id"), "born", "gone")}


def test_orphans_cascade_in_a_cyclic_graph(spark):
    t = lambda m: dt.datetime(2025, m, 1)
    people = [(1, None, t(1), None, 0), (2, 9, t(1), None, 0), (3, 2, t(2), None, 0), (4, 3, t(2), None, 0), (5, 1, t(3), None, 0), (6, 7, t(3), None, 0), (7, 1, t(4), t(5), 0), (8, 7, t(6), None, 0)]
    e = _entities(spark, people)
    got = rows(P.orphan_cascade(e, [P.Reference("p", "p", "p.boss", F.col("boss"))]))
    assert got == sorted([("p.boss", 2, "missing", 0, "2025-01"), ("p.boss", 3, "inherited", 1, "2025-02"), ("p.boss", 4, "inherited", 2, "2025-02"), ("p.boss", 6, "late", 0, "2025-03"), ("p.boss", 8, "deleted", 0, "2025-06")], key=repr)


def test_orphans_of_empty_tables_and_null_times(spark):
    e = _entities(spark, [(1, 5, None, None, 0), (2, None, None, None, 0)])
    assert rows(P.orphan_cascade(e, [P.Reference("p", "p", "r", F.col("boss"))])) == [("r", 1, "missing", 0, None)]
    empty = {"p": P.Entity(e["p"].df.limit(0), "id", "born", F.col("id"), "born", "gone")}
    assert rows(P.orphan_cascade(empty, [P.Reference("p", "p", "r", F.col("boss"))])) == []


def test_places_with_ties_and_missing(spark, hot):
    data = [("q", i, v) for i, v in enumerate([3.0, 1.0, 3.0, float("nan"), None, 2.0, -1.0])]
    got = {r.i: r.p for r in places(spark.createDataFrame(data, "g string, i int, v double"), ["g"], F.col("v"), "p", ["i"]).collect()}
    assert got == {0: 1, 2: 1, 5: 3, 1: 4, 6: 5, 3: None, 4: None}


@pytest.mark.parametrize(("matrix", "penalty", "decay", "score", "path"), [
    ([[0.9, 0.2, 0.1, 0], [0.1, 0.85, 0.3, 0.1], [0, 0.1, 0.4, 0.95]], 0.005, 0.0, 2.685, [0, 1, 3]),
    ([[0.1, 0.9, 0.2], [0.95, 0.2, 0.8]], 0.005, 0.0, None, [1, 2]),
    ([[0.95, 0, 0, 0], [0, 0.75, 0, 1.0]], 0.2, 0.0, None, [0, 1]),
])
def test_align_known_results(spark, matrix, penalty, decay, score, path):
    n = len(matrix)
    data = [("v", p, *(float(matrix[e][p]) for e in range(n))) for p in range(len(matrix[0]))]
    got = A.align(spark.createDataFrame(data, "video_id string, pos int, " + ", ".join(f"s{e} double" for e in range(n))), n, penalty, decay).first()
    assert got.path == path
    assert score is None or got.score == pytest.approx(score)


def test_align_against_brute_force(spark):
    import itertools

    r = random.Random(5)
    data, want = [], {}
    for v in range(12):
        n = r.randrange(1, 9)
        m = [[r.random() for _ in range(n)] for _ in range(3)]
        data += [(f"v{v}", p, *(m[e][p] for e in range(3))) for p in range(n)]
        if n >= 3:
            want[f"v{v}"] = max(sum(m[e][p[e]] for e in range(3)) - 0.01 * (p[2] - p[0]) for p in itertools.combinations(range(n), 3))
    got = {x.video_id: x.score for x in A.align(spark.createDataFrame(data, "video_id string, pos int, s0 double, s1 double, s2 double"), 3, 0.01).collect()}
    assert got == pytest.approx(want)


def test_moments_and_dedupe(spark):
    c = spark.createDataFrame([("V", 0, 0.9, 1.0, 1), ("V", 1, 0.8, 2.0, 1), ("V", 2, 0.7, 10.0, 1), ("V", 3, 0.6, 30.0, 2)], "video_id string, vector_id bigint, score double, timestamp double, shot_id bigint")
    m = R.moments(c, 3.0).orderBy("start").collect()
    assert [(x.start, x.end, x.n, x.score, x.best) for x in m] == [(1.0, 2.0, 2, 0.9, 0), (10.0, 10.0, 1, 0.7, 2), (30.0, 30.0, 1, 0.6, 3)]
    assert [(x.start, x.end) for x in R.moments_with_shots(c, 3.0).orderBy("start").collect()] == [(1.0, 10.0), (30.0, 30.0)]
    assert [x.vector_id for x in R.dedupe_temporal(c, 3.0).orderBy("vector_id").collect()] == [0, 2, 3]


def test_modality_fusion_known_result(spark):
    s = spark.createDataFrame([("semantic", 1, 0.2), ("semantic", 2, 0.4), ("ocr", 2, 0.0), ("ocr", 3, 1.0)], "modality string, id int, score double")
    got = {r.id: r.score for r in R.modality_fusion(s, {"semantic": 0.7, "ocr": 0.3, "asr": 0.5}).collect()}
    assert got == pytest.approx({1: 0.0, 2: 0.7, 3: 0.3})


def test_term_share_and_tokens(spark):
    df = spark.createDataFrame([("Welcome to THE show — Đẹp!",), (None,), ("",)], "t string")
    assert df.select(L.term_share(fold(F.col("t")), ["the", "show", "begins"])).first()[0] == pytest.approx(2 / 3)
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["welcome", "to", "the", "show", "đẹp"], [], []]


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "id int, text string")
    assert rows(L.bm25(docs, "id", "text", ["zzz"], 5)) == []
    assert [r.id for r in L.bm25(docs, "id", "text", ["a"], 5).collect()] == [3]


def test_detector_thresholds(spark):
    df = spark.createDataFrame([(["b", "a", "b"], ["0.35", "0.41", "0.1"]), (["a"], ["0.39"]), (["a", "c"], ["x", None]), (None, None)], "e array<string>, s array<string>")
    assert [r[0] for r in df.select(O.kept_labels(F.col("e"), F.col("s"))).collect()] == [["a", "b"], [], ["a", "c"], []]


def test_dedup_frames_known_result(spark):
    one = [1.0, 0.0]
    f = spark.createDataFrame([("V", 0, 0.0, "btc", one), ("V", 1, 0.1, "uniform", one), ("V", 2, 5.0, "uniform", one), ("A", 3, 0.0, "uniform", one), ("B", 4, 0.0, "uniform", one), ("B", 5, 0.2, "btc", one), ("B", 6, 0.3, "btc", [None, 1.0])], "video_id string, vector_id int, timestamp double, source string, vec array<double>")
    assert sorted(r.vector_id for r in C.dedup_frames(f).collect()) == [0, 2, 3, 4, 5]


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = C.dense_ids(df, ["x"]).collect()
    assert all(r.x == r.vector_id for r in got) and len(got) == 1000


def test_sampling_and_clock(spark):
    df = spark.createDataFrame([(0.0, 4.0), (2.0, 2.0)], "s double, e double")
    assert [r[0] for r in df.select(C.sample_times(F.col("s"), F.col("e"))).collect()] == [[0.0, 2.0, 4.0], [2.0]]
    assert df.select(format_timestamp(F.lit(3661.9996))).first()[0] == "01:01:02.000"
    assert df.select(C.merge_times(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.05), F.lit(9.0)), F.lit(0.0), F.lit(5.0))).first()[0] == [1.0, 2.0]


def test_csv_quotes(spark):
    df = spark.createDataFrame([("a,b",), ('say "x"',), (" y",), ("plain",)], "a string")
    assert [r[0] for r in df.select(E.csv_row(F.lit("V"), F.array(F.lit(3)), F.col("a"))).collect()] == ['V,3,"a,b"', 'V,3,"say ""x"""', 'V,3," y"', "V,3,plain"]


def test_average_precision(spark):
    df = spark.createDataFrame([("q", 1, 1.0), ("q", 2, 0.0), ("q", 3, 1.0), ("z", 1, 0.0)], "q string, rank int, relevance double")
    assert {r.q: r.ap for r in E.average_precision(df, "q").collect()} == pytest.approx({"q": (1 + 2 / 3) / 2, "z": 0.0})
