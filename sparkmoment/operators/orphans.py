"""Records that refer to records which do not exist: direct and inherited orphans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.keys import VIDEO_KEY_SQL, video_key
from ..skew import salted_join
from ..store import materialize
from ..tables import table


@dataclass(frozen=True)
class Entity:
    """A table of the foreign-key graph.

    row_id: unique id of a row. key: expression by which children refer to it (None: nobody does).
    own_time: when the row came into being. created, deleted: its life as a parent.
    """

    df: DataFrame
    row_id: str
    own_time: str
    key: Column | None = None
    created: str | None = None
    deleted: str | None = None


@dataclass(frozen=True)
class Reference:
    """``column`` of ``child`` names the key of ``parent``; a null column refers to nothing."""

    child: str
    parent: str
    label: str
    column: Column = field(hash=False)


def _parents(p: Entity) -> DataFrame:
    """One row per key. Of several rows with one key, the key lives from the first creation to the last deletion."""
    never = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    created = F.min(p.created).cast("timestamp_ntz") if p.created else F.lit(None).cast("timestamp_ntz")
    deleted = F.max(F.coalesce(F.col(p.deleted).cast("timestamp_ntz"), never)) if p.deleted else F.lit(None).cast("timestamp_ntz")
    return p.df.select("*", p.key.alias("__key")).filter("__key is not null").groupBy("__key").agg(created.alias("__born"), deleted.alias("__gone"), F.lit(True).alias("__there"))


def direct_orphans(entities: Mapping[str, Entity], r: Reference) -> DataFrame:
    """Rows (ref, child_id, kind, own_time) whose reference has no parent at the row's own time.

    kind is missing, deleted or late, the first that holds. A null own time can only be missing.
    """
    c = entities[r.child]
    own = c.df.select(F.col(c.row_id).alias("child_id"), F.col(c.own_time).cast("timestamp_ntz").alias("own_time"), r.column.alias("__key")).filter("__key is not null")
    found = salted_join(own, _parents(entities[r.parent]), ["__key"], "left", ["child_id"])
    kind = F.when(F.col("__there").isNull(), "missing").when(F.col("__gone") <= F.col("own_time"), "deleted").when(F.col("__born") > F.col("own_time"), "late")
    return found.select(F.lit(r.label).alias("ref"), "child_id", kind.alias("kind"), "own_time").filter("kind is not null")


def _depth(references: Sequence[Reference]) -> int | None:
    """Longest path of the reference graph; None where it has a cycle."""
    level = {x: 0 for r in references for x in (r.child, r.parent)}
    for _ in range(len(level) + 1):
        new = {x: max([0, *(level[r.parent] + 1 for r in references if r.child == x)]) for x in level}
        if new == level:
            return max(level.values(), default=0)
        level = new
    return None


def orphan_cascade(entities: Mapping[str, Entity], references: Sequence[Reference]) -> DataFrame:
    """Direct and inherited orphans of a foreign-key graph.

    Returns (ref, child_id, kind, depth, period): depth 0 for a reference that fails itself, k > 0
    with kind ``inherited`` for a row first reached in round k because the row it refers to is an
    orphan. Each round semi-joins the children of the last round's new orphans, less those already
    known. An acyclic graph needs as many rounds as its longest path and stays one lazy plan; with a
    cycle each round's orphans are written to the shared folder and the loop ends when none is new,
    which it must, for every round adds rows to the known ones.

    Empty tables give no rows; repeated rows keep their own ids; period is ``yyyy-MM`` of the own
    time, null with it. Extra columns of the tables are never read.
    """
    rounds = _depth(references)
    cyclic = rounds is None
    found = {r.label: direct_orphans(entities, r) for r in references}
    out = [d.withColumn("depth", F.lit(0)) for d in found.values()]
    known: dict[str, DataFrame] = {}
    fresh: dict[str, DataFrame] = {}
    for r in references:
        ids = found[r.label].select("child_id")
        fresh[r.child] = fresh[r.child].union(ids) if r.child in fresh else ids
    fresh = {t: d.distinct() for t, d in fresh.items()}
    known = dict(fresh)
    k = 0
    while cyclic or k < rounds:
        k += 1
        reached: dict[str, DataFrame] = {}
        for r in references:
            p, c = entities[r.parent], entities[r.child]
            if r.parent not in fresh or p.key is None:
                continue
            keys = p.df.select(F.col(p.row_id).alias("child_id"), p.key.alias("__key")).join(fresh[r.parent], "child_id", "left_semi").select("__key").distinct()
            rows = c.df.select(F.col(c.row_id).alias("child_id"), F.col(c.own_time).cast("timestamp_ntz").alias("own_time"), r.column.alias("__key")).filter("__key is not null")
            new = salted_join(rows, keys, ["__key"], "left_semi", ["child_id"]).drop("__key")
            if r.child in known:
                new = new.join(known[r.child], "child_id", "left_anti")
            new = new.select(F.lit(r.label).alias("ref"), "child_id", F.lit("inherited").alias("kind"), "own_time")
            if cyclic:
                new = materialize(new, "orphans")
            out.append(new.withColumn("depth", F.lit(k)))
            ids = new.select("child_id")
            reached[r.child] = reached[r.child].union(ids) if r.child in reached else ids
        fresh = {t: d.distinct() for t, d in reached.items()}
        if cyclic and all(d.isEmpty() for d in fresh.values()):
            break
        for t, d in fresh.items():
            known[t] = known[t].union(d).distinct() if t in known else d
            if cyclic:
                known[t] = materialize(known[t], "known")
    return reduce(DataFrame.unionByName, out).select("ref", "child_id", "kind", "depth", F.date_format("own_time", "yyyy-MM").alias("period"))


def _graph(spark: SparkSession, d: str) -> tuple[dict[str, Entity], list[Reference]]:
    entities = {
        "videos": Entity(table(spark, d, "videos"), "video_id", "created_at", video_key("video_id"), "created_at", "deleted_at"),
        "shots": Entity(table(spark, d, "shots"), "shot_id", "created_at", F.col("shot_id"), "created_at", "deleted_at"),
        "frames": Entity(table(spark, d, "frames"), "vector_id", "ingested_at"),
    }
    references = [
        Reference("shots", "videos", "shots.video_id", video_key("video_id")),
        Reference("frames", "videos", "frames.video_id", video_key("video_id")),
        Reference("frames", "shots", "frames.shot_id", F.when(F.col("shot_id") >= 0, F.col("shot_id"))),
    ]
    return entities, references


def p2_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per reference, kind and month."""
    rows = orphan_cascade(*_graph(spark, d))
    return rows.groupBy("ref", "kind", "depth", "period").agg(F.count(F.lit(1)).alias("n_rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_cascade(*_graph(spark, d)).filter("depth = 0").select("ref", "child_id", "kind", "period")


_V = VIDEO_KEY_SQL.format("video_id")
_DIRECT_SQL = f"""
WITH v AS (SELECT {_V} AS k, min(created_at) AS born, max(coalesce(deleted_at, TIMESTAMP '9999-12-31')) AS gone FROM videos GROUP BY 1),
s AS (SELECT shot_id AS k, created_at AS born, deleted_at AS gone FROM shots),
r AS (
  SELECT 'shots.video_id' AS ref, shot_id AS child_id, {_V} AS k, created_at AS own FROM shots
  UNION ALL SELECT 'frames.video_id', vector_id, {_V}, ingested_at FROM frames),
f AS (
  SELECT ref, child_id, own, CASE WHEN v.k IS NULL THEN 'missing' WHEN gone <= own THEN 'deleted' WHEN born > own THEN 'late' END AS kind
  FROM r LEFT JOIN v USING (k) WHERE r.k IS NOT NULL
  UNION ALL
  SELECT 'frames.shot_id', vector_id, ingested_at, CASE WHEN s.k IS NULL THEN 'missing' WHEN gone <= ingested_at THEN 'deleted' WHEN born > ingested_at THEN 'late' END
  FROM frames LEFT JOIN s ON s.k = frames.shot_id WHERE frames.shot_id >= 0),
direct AS (SELECT ref, child_id, kind, strftime(own, '%Y-%m') AS period FROM f WHERE kind IS NOT NULL)
"""
_INHERITED_SQL = """,
os AS (SELECT DISTINCT child_id FROM direct WHERE ref = 'shots.video_id'),
ofr AS (SELECT DISTINCT child_id FROM direct WHERE ref LIKE 'frames.%'),
allr AS (
  SELECT ref, kind, 0 AS depth, period FROM direct
  UNION ALL
  SELECT 'frames.shot_id', 'inherited', 1, strftime(ingested_at, '%Y-%m') FROM frames
  WHERE shot_id IN (SELECT child_id FROM os) AND vector_id NOT IN (SELECT child_id FROM ofr))
SELECT ref, kind, CAST(depth AS INTEGER) AS depth, period, count(*) AS n_rows FROM allr GROUP BY ALL
"""
QUERIES = {"p2_found": p2_found, "p2_cascade": p2_cascade}
SQL = {"p2_found": _DIRECT_SQL + "SELECT ref, child_id, kind, period FROM direct", "p2_cascade": _DIRECT_SQL + _INHERITED_SQL}
