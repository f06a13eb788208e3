"""The k most similar vectors of every vector, by multi-probe p-stable hashing.

Vectors are scaled to unit length, so that the nearest by Euclidean distance are the most similar by
cosine. Each of ``tables`` hash tables cuts the space by ``functions`` projections on normally
distributed (2-stable) directions, floor((a x + b) / width). A vector is filed in its own bucket of
each table and looked up there and in the ``probes`` - 1 buckets it most likely just missed:
perturbations by one cell of one or more projections, in the order of their squared distances to the
borders crossed. In each bucket the vectors looked up meet the vectors filed as one matrix product,
candidates of all buckets are merged per vector, and the best are ranked by their exact cosine.

The number of projections follows from the number of vectors in a space, each space having its own.
Equal vectors are filed k + 1 times at most (those with the smallest ids can be anyone's best only),
the others' neighbours follow from that. Buckets of very many vectors are cut into a grid of filed
and looked-up portions, each pair of which meets in a task of its own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..skew import hot_keys, salted_join
from ..store import materialize
from ..tables import table

K = 5
TABLES = 4
PROBES = 4
WIDTH = 1.8
#: Vectors for which six projections a table keep the buckets at some hundreds; each four times as many add one.
SIX_AT = 45_000
#: Buckets with more vectors than SPLIT_ABOVE are cut into portions of about PORTION.
SPLIT_ABOVE, PORTION = 20_000, 5_000
#: Similarities are compared to this many decimals.
DECIMALS = 9
_SEED = 20_011


def functions_for(n: Column) -> Column:
    """Projections a table for a space of n vectors."""
    return F.greatest(F.lit(1), F.round(6 + F.log(F.greatest(n, F.lit(1)) / F.lit(float(SIX_AT))) / math.log(4)).cast("int"))


def _projections(dim: int, functions: int, tables: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(_SEED)
    shift = r.random(tables * functions) * width
    spread = r.integers(1, 1 << 62, functions + 1)
    return r.standard_normal((dim, tables * functions)), shift, spread


def _perturbations(inside: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    """For each probe the steps (-1, 0, 1) of every vector in every projection, in order of success.

    ``inside`` is the place within the bucket, 0 to 1: crossing the lower border costs inside ** 2.
    """
    q, m = inside.shape
    yield np.zeros((q, m), np.int64)
    if probes == 1:
        return
    cost = np.concatenate([inside**2, (1 - inside) ** 2], 1)
    order = np.argsort(cost, 1)[:, : 2 * m]
    cost = np.take_along_axis(cost, order, 1)
    few = min(2 * m, probes + 2)  # a set of rank r among the sums uses none of the borders beyond the r-th
    sets = [s for k in range(1, min(few, 4) + 1) for s in itertools.combinations(range(few), k)]
    sums = np.stack([cost[:, list(s)].sum(1) for s in sets], 1)
    for j, s in enumerate(sets):  # both borders of one projection can't be crossed
        if len(s) > 1:
            d = np.sort(order[:, list(s)] % m, 1)
            sums[(d[:, 1:] == d[:, :-1]).any(1), j] = np.inf
    best = np.argsort(sums, 1, kind="stable")[:, : probes - 1]
    for k in range(min(probes - 1, best.shape[1])):
        step = np.zeros((q, m), np.int64)
        for j in np.unique(best[:, k]).tolist():
            rows = np.flatnonzero((best[:, k] == j) & np.isfinite(sums[:, j]))
            for i in sets[j]:
                o = order[rows, i]
                step[rows, o % m] += np.where(o < m, -1, 1)
        yield step


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of lists of one length as a float64 matrix."""
    flat = vectors.flatten()
    return np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(vectors), -1)


def _good(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x).all(1) & (x != 0).any(1)


def _buckets(x: np.ndarray, space: np.ndarray, functions: int, tables: int, width: float, probes: int) -> Iterator[tuple[int, np.ndarray]]:
    """(probe, bucket of each row) for each table and probe; probe 0 is the row's own bucket."""
    a, shift, spread = _projections(x.shape[1], functions, tables, width)
    y = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ a + shift) / width
    for t in range(tables):
        part = y[:, t * functions : (t + 1) * functions]
        cell = np.floor(part).astype(np.int64)
        for k, step in enumerate(_perturbations(part - cell, probes)):
            h = ((cell + step) * spread[:functions]).sum(1) + (space + t) * spread[functions]
            yield k, h ^ (h >> 29)


def _raw(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * x.shape[1]), len(x), [None, pa.py_buffer(x.astype("<f4").tobytes())]).cast(pa.binary())


def _file(rows: DataFrame, tables: int, width: float, probes: int) -> DataFrame:
    """Rows (bucket, role, id, raw) of every bucket in which a vector is looked up (role 2), and also filed (3), its own.

    ``rows`` has (space, id, vec, functions). With no probes only (bucket) of the own buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, functions = np.asarray(b.column(2).value_lengths().fill_null(0)), np.asarray(b.column(3))
            for dim, m in np.unique(np.stack([size, functions], 1)[size > 0], axis=0).tolist():
                part = b.filter(pa.array((size == dim) & (functions == m)))
                x = _matrix(part.column(2))
                ok = np.flatnonzero(_good(x))
                if not len(ok):
                    continue
                x, ids, space = x[ok], np.asarray(part.column(1))[ok], np.asarray(part.column(0))[ok]
                raw = _raw(x) if probes else None
                for k, bucket in _buckets(x, space, m, tables, width, max(probes, 1)):
                    if probes:
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(x), 3 if k == 0 else 2, np.int8)), pa.array(ids), raw], names=["bucket", "role", "id", "raw"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(bucket)], names=["bucket"])

    return rows.select("space", "id", "vec", "functions").mapInArrow(run, "bucket bigint" + (", role tinyint, id bigint, raw binary" if probes else ""))


def _portioned(met: DataFrame, portions: DataFrame) -> DataFrame:
    """``met`` with the buckets of ``portions`` (bucket, parts) cut into cells: row i of the grid files a portion, column i looks it up."""
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    grid = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda i, j, role: F.struct((i * F.col("parts") + j + 1).alias("cell"), F.lit(role).cast("tinyint").alias("role"))
    filed = F.when(F.col("role").bitwiseAND(1) != 0, F.transform(grid, lambda j: cell(mine, j, 1)))
    asked = F.when(F.col("role").bitwiseAND(2) != 0, F.transform(grid, lambda i: cell(i, mine, 2)))
    none = F.array().cast("array<struct<cell:int,role:tinyint>>")
    cells = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("cell"), F.col("role").alias("role")))).otherwise(F.concat(F.coalesce(filed, none), F.coalesce(asked, none)))
    out = met.join(portions, "bucket", "left").select("bucket", F.explode(cells).alias("c"), "id", "raw")
    return out.select(F.when(F.col("c.cell") == 0, F.col("bucket")).otherwise(F.xxhash64("bucket", "c.cell")).alias("bucket"), F.col("c.role").alias("role"), "id", "raw")


def _ranked(met: DataFrame, k: int) -> DataFrame:
    """(id, other, similarity, rank): the k best of each vector looked up, over all its buckets."""
    best = met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(k), "id bigint, best array<struct<far double, id bigint>>")
    ranked = best.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best"))  # a list of k for each bucket looked up
    return ranked.select("id", F.posexplode("best").alias("pos", "b")).select("id", F.col("b.id").alias("other"), (-F.col("b.far")).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def _best(query: np.ndarray, filed: np.ndarray, q_id: np.ndarray, f_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query's index, id, similarity) of the k best of each query; ``f_id`` ascends."""
    s = np.round(query @ filed.T, DECIMALS)
    at = np.minimum(np.searchsorted(f_id, q_id), len(f_id) - 1)
    own = np.flatnonzero(f_id[at] == q_id)
    s[own, at[own]] = -2.0
    if s.shape[1] > k:
        # A little below the k-th, for products are summed in another order than the final ones.
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * 10.0**-DECIMALS
        row, col = np.nonzero(s >= np.maximum(least, -1.5)[:, None])
    else:
        row, col = np.nonzero(s > -1.5)
    sim = np.round((query[row] * filed[col]).sum(1), DECIMALS)
    order = np.lexsort((col, -sim, row))
    row, col, sim = row[order], col[order], sim[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
    keep = rank < k
    return row[keep], f_id[col[keep]], sim[keep]


def _meet(k: int):
    """Function over batches (bucket, role, id, raw) sorted by bucket: (id, best) of each vector looked up."""

    def group(role: np.ndarray, ids: np.ndarray, raw: pa.Array) -> Iterator[pa.RecordBatch]:
        filed, asked = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        if not len(filed) or not len(asked):
            return
        x = np.frombuffer(b"".join(raw.to_pylist()), "<f4").reshape(len(role), -1).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        filed = filed[np.argsort(ids[filed], kind="stable")]
        step = max(1, (1 << 21) // len(filed))
        for a in range(0, len(asked), step):
            part = asked[a : a + step]
            row, other, sim = _best(x[part], x[filed], ids[part], ids[filed], k)
            n = np.bincount(row, minlength=len(part))
            some = n > 0
            off = np.concatenate([[0], np.cumsum(n[some])]).astype(np.int32)
            best = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(-sim), pa.array(other)], names=["far", "id"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[part][some]), best], names=["id", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            bucket = np.asarray(b.column(0))
            begins = np.flatnonzero(np.diff(bucket)) + 1
            if held and np.asarray(held[-1].column(0))[-1] != bucket[0]:
                begins = np.concatenate([[0], begins])
            if len(begins):
                whole = pa.Table.from_batches([*held, b.slice(0, int(begins[-1]))]).combine_chunks()
                held = []
                yield from each(whole)
                b = b.slice(int(begins[-1]))
            held.append(b)
        if held:
            yield from each(pa.Table.from_batches(held).combine_chunks())

    def each(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        bucket, role, ids = (np.asarray(t.column(c)) for c in ("bucket", "role", "id"))
        raw = t.column("raw").chunk(0)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
        for lo, hi in itertools.pairwise(edge):
            if hi - lo > 1:
                yield from group(role[lo:hi], ids[lo:hi], raw.slice(lo, hi - lo))

    return run


def usable(vec: str) -> Column:
    """Not null or empty, all finite (NaN counts as larger than infinity), not all zero."""
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest_vectors(df: DataFrame, space: str, key: str, vec: str, k: int = K, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH) -> DataFrame:
    """Rows (id, other, similarity, rank): the k vectors of the same ``space`` most similar to each vector by cosine.

    Similarities equal to nine decimals are ordered by the smaller id. Vectors that are null, empty,
    not finite or all zero take no part, nor do rows with a null key; the vectors of one space must
    have one length. Every vector is filed and looked up; recall against brute force is in the README.
    """
    rows = df.select(F.xxhash64(space).alias("space"), F.col(key).cast("bigint").alias("id"), F.col(vec).alias("vec")).filter(F.col("id").isNotNull() & usable("vec"))
    same = ["space", "h1", "h2"]
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.hash("vec")})
    few = rows.withColumn("copy", F.row_number().over(W.partitionBy(*same).orderBy("id"))).filter(F.col("copy") <= k + 1)
    sizes = rows.groupBy("space").agg(functions_for(F.count(F.lit(1))).alias("functions"))
    # Written once: the vectors are filed, counted and compared with their copies from there.
    few = materialize(salted_join(few, sizes, ["space"], "inner", ["id"], hot_keys(df.select(F.xxhash64(space).alias("space")), ["space"])), "filed")
    own = _file(few, tables, width, 0).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(own.filter(F.col("n") > SPLIT_ABOVE).select("bucket", F.ceil(F.col("n") / PORTION).cast("int").alias("parts")), "large")
    met = _file(few, tables, width, probes)
    found = _ranked(met if large.isEmpty() else _portioned(met, large), k)

    # Copies beyond the first k + 1 have the k first ones as their neighbours.
    firsts = few.groupBy(*same).agg(F.max("copy").alias("n"), F.max("id").alias("last"), F.array_sort(F.collect_list("id")).alias("ids")).filter(F.col("n") > k)
    firsts = firsts.select(*same, "last", F.slice("ids", 1, k).alias("ids"))
    ids = materialize(rows.select("id", *same), "ids")
    more = salted_join(ids, firsts, same, "inner", ["id"], hot_keys(ids, same)).filter("id > last")
    more = more.select("id", F.posexplode("ids").alias("pos", "other")).select("id", "other", F.lit(1.0).alias("similarity"), (F.col("pos") + 1).alias("rank"))
    return found.unionByName(more)


def exact_neighbours(df: DataFrame, space: str, key: str, vec: str, asked: Column, k: int = K) -> DataFrame:
    """As ``nearest_vectors`` by brute force, for the vectors that are ``asked`` only: every one of them meets all of its space, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column(2).value_lengths())
            for dim in np.unique(size).tolist():
                part = b.filter(pa.array(size == dim))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(1), _raw(_matrix(part.column(2)))], names=["bucket", "role", "id", "raw"])

    role = F.when(F.coalesce(asked, F.lit(False)), 3).otherwise(1).cast("tinyint").alias("role")
    rows = df.select(F.xxhash64(space).alias("space"), F.col(key).cast("bigint").alias("id"), F.col(vec).alias("vec"), role).filter(F.col("id").isNotNull() & usable("vec"))
    parts = rows.groupBy(F.col("space").alias("bucket")).agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("int").alias("parts"))
    met = rows.mapInArrow(run, "bucket bigint, role tinyint, id bigint, raw binary")
    return _ranked(_portioned(met, materialize(parts, "portions")), k)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as long as their version says."""
    dims = table(spark, d, "siglip2_meta").select("embedding_version", "embedding_dim").distinct()
    v = table(spark, d, "manifest_siglip2").select("vector_id", "embedding_version", "vec").join(dims, "embedding_version")
    return v.filter(F.size("vec") == F.col("embedding_dim")).select("vector_id", "embedding_version", "vec")


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector with their similarity and rank."""
    return nearest_vectors(_vectors(spark, d), "embedding_version", "vector_id", "vec")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = p6_nearest(spark, d)
    return near.select(F.least("id", "other").alias("vector_id_a"), F.greatest("id", "other").alias("vector_id_b")).distinct()


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """Per version: vectors with an id divisible by 20, their neighbours by brute force over all vectors, and whether 0.9 of these are found."""
    v = _vectors(spark, d)
    true = exact_neighbours(v, "embedding_version", "vector_id", "vec", F.col("vector_id") % 20 == 0).select("id", "other")
    near = p6_nearest(spark, d).select("id", "other").withColumn("found", F.lit(1))
    both = true.join(near, ["id", "other"], "left").join(v.select(F.col("vector_id").alias("id"), "embedding_version"), "id")
    return both.groupBy("embedding_version").agg(F.count_distinct("id").alias("n_vectors"), F.count(F.lit(1)).alias("n_neighbours"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("enough"))


QUERIES = {"p6_found": p6_found, "p6_nearest": p6_nearest, "p6_recall": p6_recall}
SQL = {
    "p6_recall": f"""WITH v AS (SELECT vector_id, embedding_version FROM manifest_siglip2 JOIN siglip2_meta USING (embedding_version)
  WHERE len(vec) = embedding_dim AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
n AS (SELECT embedding_version, count(*) AS n FROM v GROUP BY 1)
SELECT embedding_version, count(*) AS n_vectors, CAST(sum(least(n - 1, {K})) AS BIGINT) AS n_neighbours, true AS enough FROM v JOIN n USING (embedding_version) WHERE vector_id % 20 = 0 AND n > 1 GROUP BY 1"""
}
