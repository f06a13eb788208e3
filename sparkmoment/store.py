"""Shared storage for cut lineage and reused intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables written in this session, by the DataFrame that reads them.
_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent and the master is local (tests on one machine) a temporary folder
    is made and set; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="sparkmoment-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return f"file://{path}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Survives the loss of executors, cuts the lineage, and lets several later branches read only
    the columns each of them needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out, lambda _, key=id(out): _WRITTEN.pop(key, None)), path)
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that nothing still to be computed reads."""
    for df in tables:
        _, path = _WRITTEN.pop(id(df), (None, None))
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def present(df: DataFrame) -> bool:
    """Whether a table that ``materialize`` wrote is still there; the owner of the shared folder may have cleared it."""
    _, path = _WRITTEN.get(id(df), (None, None))
    if not path:
        return False
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)
