"""Readers, writers and streaming jobs."""

import datetime as dt
import json
import zipfile

import numpy as np
import pytest

from sparkmoment.sources import files as S
from sparkmoment.streaming import jobs as J


def test_json_lines(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"vector_id": 1, "video_id": "a"}\n\n{broken\n{"vector_id": 2, "video_id": "b", "object_labels": ["x"]}\n')
    assert sorted(r.vector_id for r in S.read_json_lines(spark, str(p), S.FRAME).filter("vector_id is not null").collect()) == [1, 2]
    with pytest.raises(Exception):
        S.read_json_lines(spark, str(p), S.FRAME, strict=True).collect()
    assert S.read_json_lines(spark, str(tmp_path / "none.jsonl"), S.FRAME).count() == 0


def test_transcripts(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    rows = [{"video_id": "a", "text": "old", "segments": []}, {"video_id": "b", "text": "x", "segments": [{"text": "hi"}]}, {"video_id": "a", "text": "new", "segments": [{"text": "n", "start": 1.0, "end": 2.0, "frame": 5}]}]
    p.write_text("\n".join(map(json.dumps, rows)) + "\nnonsense\n")
    got = {r.video_id: r for r in S.read_transcripts(spark, str(p)).collect()}
    assert got["a"].text == "new" and got["b"].segments[0].start == 0.0 and got["b"].segments[0].frame is None
    S.write_transcripts(S.read_transcripts(spark, str(p)), str(tmp_path / "out"))
    assert {r.video_id: r.text for r in S.read_transcripts(spark, str(tmp_path / "out")).collect()} == {"a": "n", "b": "hi"}


def test_time_map(spark, tmp_path):
    (tmp_path / "M01_V001.csv").write_text("n,pts_time,fps,frame_idx\n1,0,25,0\n2,3.6,25,90\nx,y,z,w\n")
    (tmp_path / "N001-V001.csv").write_text("n,pts_time,fps,frame_idx\n1,0,25,0\n2,2.0,25,50\n")
    got = sorted((r.video_id, r.n, r.frame_id) for r in S.read_time_map(spark, str(tmp_path)).collect())
    assert got == [("M01_V001", 1, 0), ("M01_V001", 2, 90), ("N001-V001", 1, 0), ("N001-V001", 2, 2000)]


def test_matrices_and_archives(spark, tmp_path):
    m = np.arange(30, dtype=np.float32).reshape(10, 3)
    np.save(tmp_path / "a.npy", m)
    np.savez(tmp_path / "b.npz", frame_ids=np.array([7, 9]), features=m[:2])
    (tmp_path / "c.npz").write_bytes(b"damaged")
    got = S.read_matrix(spark, str(tmp_path), 4).orderBy("file", "row").collect()
    assert [(r.file, r.row, r.frame_id) for r in got] == [("a", i, None) for i in range(10)] + [("b", 0, 7), ("b", 1, 9)]
    assert got[3].vec == [9.0, 10.0, 11.0]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("v/001.json", "{}")
        z.writestr("v/readme.txt", "")
    (tmp_path / "bad.zip").write_bytes(b"no")
    assert [r.member for r in S.zip_members(spark, f"{tmp_path}/*.zip").collect()] == ["v/001.json"]


def test_streams(spark, tmp_path):
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    data = [("V", 1, t(0), 0.5), ("V", 1, t(1), 0.9), ("V", 2, t(100), 0.3), ("W", 1, t(0), 0.1), ("W", 9, t(500), 0.1)]
    spark.createDataFrame(data, "video_id string, frame_id bigint, ts timestamp, score double").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = lambda: spark.readStream.schema("video_id string, frame_id bigint, ts timestamp, score double").parquet(f"{tmp_path}/in")

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run(J.moments_stream(src()), "moments").collect()
    assert {(r.video_id, r.n, r.score) for r in got} >= {("V", 2, 0.9), ("V", 1, 0.3), ("W", 1, 0.1)}
    assert run(J.distinct_frames_stream(src()), "frames").count() == 4
    J.upsert_stream(src(), f"{tmp_path}/cat", f"{tmp_path}/cp", ["video_id", "frame_id"], "ts").awaitTermination(120)
    cat = J.latest_catalog(spark.read.parquet(f"{tmp_path}/cat"), ["video_id", "frame_id"], "ts")
    assert {(r.video_id, r.frame_id): r.score for r in cat.collect()} == {("V", 1): 0.9, ("V", 2): 0.3, ("W", 1): 0.1, ("W", 9): 0.1}
