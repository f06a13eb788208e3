"""Readers and writers: JSON lines, detector output, time maps, vector matrices, submissions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAME = (
    "vector_id bigint, video_id string, frame_id bigint, frame_unit string, keyframe_path string, object_labels array<string>, metadata_keywords array<string>, "
    "title string, description string, video_path string, object_path string, metadata_path string, clip_feature_index bigint, ocr_done boolean, shot_id bigint, "
    "timestamp double, source string, model_version string, embedding_version string"
)
SEGMENT = "struct<text:string,start:double,end:double,frame:bigint>"
TRANSCRIPT = f"video_id string, text string, segments array<{SEGMENT}>"
VIDEO_META = "video_id string, title string, description string, metadata_keywords array<string>"
DETECTIONS = "detection_class_entities array<string>, detection_scores array<string>, detection_boxes array<array<double>>"
DEV_SET = "query string, gt_video_id string, gt_frame_id bigint"


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines: lenient drops malformed lines, strict fails on the first one. A missing path gives no rows when lenient."""
    if not strict and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts with one row per video: the last line wins; bounds default to 0.0.

    A line's place is its file's name and its offset in the file, read as text, so files of any
    number are read in parallel.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = lines.select("file", "block", "line", F.from_json("value", TRANSCRIPT).alias("t")).filter("t.video_id is not null")
    last = rows.groupBy("t.video_id").agg(F.max_by("t", F.struct("file", "block", "line")).alias("t")).select("t.*")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    fixed = F.transform("segments", lambda s: F.struct(s["text"].alias("text"), zero(s["start"]).alias("start"), zero(s["end"]).alias("end"), s["frame"].alias("frame")))
    return last.select("video_id", "text", fixed.alias("segments"))


def write_transcripts(df: DataFrame, path: str) -> None:
    """One line per video; the text is the segments' texts joined by blanks."""
    df.withColumn("text", F.array_join(F.transform("segments", lambda s: s["text"]), " ")).write.mode("overwrite").json(path)


def read_time_map(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, n, pts_time, fps, frame_id) from CSV maps named by their video.

    Videos N001 to N100 have a variable rate: their frame number is the time in milliseconds,
    rounded half-even; others have ``frame_idx``. Rows that can't be read are left out; of repeated
    frames the last n wins.
    """
    raw = spark.read.option("header", True).schema("n string, pts_time string, fps string, frame_idx string").csv(path)
    c = lambda name, kind: F.col(name).try_cast(kind)
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.csv)?$", 1).alias("video_id"), c("n", "int").alias("n"), c("pts_time", "double").alias("pts_time"), c("fps", "double").alias("fps"), c("frame_idx", "double").alias("idx"))
    number = F.regexp_extract(F.upper("video_id"), r"^N(\d{3})(?!\d)", 1).try_cast("int")
    frame = F.when(number.between(1, 100), F.bround(F.col("pts_time") * 1000)).otherwise(F.col("idx")).cast("bigint")
    rows = rows.withColumn("frame_id", frame).filter("frame_id is not null and pts_time is not null")
    return rows.groupBy("video_id", "frame_id").agg(F.max_by(F.struct("n", "pts_time", "fps"), "n").alias("x")).select("video_id", "x.*", "frame_id")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """(path, entities, scores) of detector files, one JSON document each; unreadable ones have nulls."""
    raw = spark.read.option("wholetext", True).text(path)
    parsed = F.from_json("value", DETECTIONS)
    return raw.select(F.col("_metadata.file_path").alias("path"), parsed["detection_class_entities"].alias("entities"), parsed["detection_scores"].alias("scores"))


def read_dev_set(spark: SparkSession, path: str) -> DataFrame:
    """Dev queries; lines without a query or a video are left out."""
    return read_json_lines(spark, path, DEV_SET).filter("query is not null and gt_video_id is not null")


def write_submission(lines: DataFrame, path: str, query: str = "query_id", line: str = "line", order: str = "rank") -> None:
    """A folder per query with its lines in order, plain text without a header."""
    lines.repartition(query).sortWithinPartitions(query, order).select(query, line).write.mode("overwrite").partitionBy(query).text(path)


class _Rows(InputPartition):
    def __init__(self, path: str, member: str, lo: int, hi: int):
        self.path, self.member, self.lo, self.hi = path, member, lo, hi


class _MatrixReader(DataSourceReader):
    """Row ranges of .npy matrices (memory-mapped: a task reads its own rows only) and .npz archives."""

    ROWS = 8192

    def __init__(self, options: dict[str, str]):
        self.root = Path(options["path"])
        self.rows = int(options.get("rows_per_task", self.ROWS))

    def partitions(self) -> list[InputPartition]:
        files = sorted(self.root.rglob("*.np[yz]")) if self.root.is_dir() else [self.root]
        out: list[InputPartition] = []
        for f in files:
            if f.suffix == ".npy":
                n = np.load(f, mmap_mode="r").shape[0]
                out += [_Rows(str(f), "", a, min(n, a + self.rows)) for a in range(0, n, self.rows)]
            else:
                out.append(_Rows(str(f), "features", 0, -1))
        return out or [_Rows("", "", 0, 0)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        if not part.path:
            return
        stem = Path(part.path).stem
        if part.member:
            try:
                with np.load(part.path) as z:
                    m, ids = z["features"], z["frame_ids"]
            except (OSError, KeyError, ValueError, zipfile.BadZipFile):
                return  # empty or damaged archives are passed over
            for i, v in enumerate(m):
                yield stem, i, int(ids[i]), [float(x) for x in v]
            return
        m = np.load(part.path, mmap_mode="r")
        for i in range(part.lo, part.hi):
            yield stem, i, None, [float(x) for x in m[i]]


class MatrixSource(DataSource):
    """``spark.read.format("matrix").load(path)``: (file, row, frame_id, vec) of .npy / .npz files."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "file string, row bigint, frame_id bigint, vec array<float>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _MatrixReader(self.options)


def read_matrix(spark: SparkSession, path: str, rows_per_task: int = _MatrixReader.ROWS) -> DataFrame:
    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").option("rows_per_task", rows_per_task).load(path)


def zip_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(archive, member, text) of the matching members of ZIP archives; damaged archives give none."""

    def run(parts):
        import pandas as pd

        for pdf in parts:
            out = []
            for p, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(p, n, z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if n.endswith(suffix)]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["archive", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, text string")


def read_video_meta(spark: SparkSession, path: str) -> DataFrame:
    """Video metadata of JSON lines, one row per video (the last line wins); missing keyword lists are empty."""
    rows = read_json_lines(spark, path, VIDEO_META).filter("video_id is not null").withColumn("__n", F.monotonically_increasing_id())
    last = rows.groupBy("video_id").agg(F.max_by(F.struct("title", "description", "metadata_keywords"), "__n").alias("x")).select("video_id", "x.*")
    return last.withColumn("metadata_keywords", F.coalesce("metadata_keywords", F.array().cast("array<string>")))


def write_video_meta(df: DataFrame, path: str) -> None:
    df.select("video_id", "title", "description", "metadata_keywords").write.mode("overwrite").json(path)


def read_colours(spark: SparkSession, path: str) -> DataFrame:
    """(vector_id, dom, fracs, obj) of colour profiles in JSON lines; lines without an id are left out."""
    return read_json_lines(spark, path, "vector_id bigint, dom string, fracs map<string,double>, obj map<string,array<string>>").filter("vector_id is not null")


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(results: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines in a new folder; an existing one is an error."""
    results.write.mode("errorifexists").json(path)


def package_submission(folder: str, target: str) -> str:
    """The submission's files (a few small ones, written by ``write_submission``) in a ZIP under ``submission/``, by query.

    Runs on the driver and writes where its file system says; Spark's own marker files are left out.
    """
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        parts: dict[str, list[Path]] = {}
        for p in sorted(Path(folder).rglob("part-*")):
            parts.setdefault(p.parent.name.split("=", 1)[-1], []).append(p)
        for query, files in parts.items():
            z.writestr(f"submission/{query}.csv", "".join(p.read_text() for p in files))
    return target
