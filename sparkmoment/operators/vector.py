"""Cosine search and pooling of frame vectors.

Queries are few rows by nature (a user's query and its variants) and are sent to the vectors, once they
are counted; similarities are computed where the vectors lie, so a search moves k rows per task and query
only. Many queries are cut into blocks, and each block meets all vectors in one task that keeps its k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.vectors import FLOOR, cosine, dot, norm, normalize
from ..skew import grouped_places, salted_join, spread
from .blocks import BLOCK, CHUNK, meet

#: Queries of a block; as many may be sent to every task at once.
QUERY_BLOCK = 10_000
#: Queries of ``knn`` that are sent to the vectors; of more, blocks meet all vectors.
FEW_QUERIES = 1_000
#: About as many similarities a task of such a block looks at together.
CELLS = 1 << 22
#: Parts of the vectors that meet each block of queries in a task of their own.
GRID = 64


def scored(frames: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """Frames with (query_id, score): cosine to each query vector ``qvec``, grouped by nothing else.

    Norms are taken once per vector, not per pair. Up to ``block`` queries are broadcast. More are cut
    into blocks, each of which meets each of GRID parts of the frames in one task: queries are then
    repeated GRID times and frames once per block. Rows whose query has no id are left out.
    """
    q = queries.select("query_id", normalize(F.col("qvec")).alias("qvec")).filter("query_id is not null")
    f = spread(frames).withColumn("vec", normalize(F.col("vec")))
    n = q.count()
    if n <= block:
        pairs = f.crossJoin(F.broadcast(q))
    else:
        blocks = -(-n // block)
        q = q.withColumns({"__b": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "__p": F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))})
        f = f.withColumns({"__p": F.pmod(F.xxhash64("vector_id"), F.lit(GRID)).cast("int"), "__b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        pairs = f.join(q, ["__b", "__p"]).drop("__b", "__p")
    return pairs.withColumn("score", dot(F.col("vec"), F.col("qvec"))).drop("qvec")


def _nearest(by_length: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Function over batches (vector_id, video_id, vec): each query's k best of the batch, and what equals the last of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column(2).value_lengths().fill_null(0))
            for dim, (at, q) in by_length.items():
                rows = np.flatnonzero(size == dim)
                if not len(rows):
                    continue
                some = b.take(pa.array(rows))
                x = np.asarray(some.column(2).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(rows), dim)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), FLOOR)
                step = max(1, (1 << 22) // len(rows))
                for lo in range(0, len(at), step):
                    s = q[lo : lo + step] @ x.T
                    s[np.isnan(s)] = -np.inf
                    # A little below the k-th, for the order is that of rounded values.
                    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 1e-9 if s.shape[1] > k else np.full(len(s), -np.inf)
                    of, row = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(at[lo + of]), some.column(0).take(take), some.column(1).take(take), pa.array(s[of, row])], names=["__q", "vector_id", "video_id", "score"])

    return run


def _unit(vecs: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists of ``dim`` numbers, and these scaled to unit length; a null in a list is NaN."""
    at = np.flatnonzero(np.asarray(vecs.value_lengths().fill_null(0)) == dim)
    x = np.asarray(vecs.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(at), dim)
    return at, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), FLOOR)


class _Best:
    """The k rows most similar to each of some queries among the rows seen so far; of equals those that came first."""

    def __init__(self, at: np.ndarray, q: np.ndarray, k: int):
        self.at, self.q, self.k = at, q, k
        self.of, self.score, self.ids, self.least = np.empty(0, int), np.empty(0), None, None

    def add(self, x: np.ndarray, ids: pa.Table) -> None:
        s, k = self.q @ x.T, self.k
        if self.least is None:
            s[np.isnan(s)] = -np.inf
            # A little below the k-th, for the order is that of rounded values.
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 1e-9 if s.shape[1] > k else np.full(len(s), -np.inf)
        else:
            least = self.least + 4e-10  # what rounds to the k-th came too late
        of, row = np.nonzero(s > least[:, None])
        if self.least is not None and not len(of):
            return
        some = ids.take(pa.array(row))
        of, score = np.concatenate([self.of, of]), np.concatenate([self.score, s[of, row]])
        rounded = np.round(score, 9)
        order = np.lexsort((-rounded, of))  # stable
        n = np.bincount(of, minlength=len(self.q))
        start = np.cumsum(n) - n
        order = order[np.arange(len(of)) - np.repeat(start, n) < k]
        self.of, self.score = of[order], score[order]
        self.ids = (some if self.ids is None else pa.concat_tables([self.ids, some])).take(pa.array(order)).combine_chunks()
        n = np.minimum(n, k)
        self.least = np.full(len(self.q), -np.inf)
        full = np.flatnonzero(n == k)
        self.least[full] = np.round(self.score[(np.cumsum(n) - 1)[full]], 9)

    def rows(self, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.ids is None or not len(self.of):
            return
        n = np.bincount(self.of, minlength=len(self.q))
        rank = np.arange(len(self.of)) - np.repeat(np.cumsum(n) - n, n) + 1
        yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.at[self.of])), *(c.combine_chunks() for c in self.ids.columns), pa.array(self.score), pa.array(rank.astype(np.int32))], names=["query_id", "vector_id", "video_id", "score", "rank"])


def _block_best(k: int):
    """Work of a block (``blocks.meet``): its queries (query_id, qvec) and all rows (vector_id, video_id, vec), sorted by vector_id."""

    def work(asked: pa.Table, chunks: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        query_ids, qvecs = (asked[c].combine_chunks() for c in ("query_id", "qvec"))
        step = max(1, CELLS // CHUNK)
        parts: dict[int, list[_Best]] = {}
        for dim in np.unique(np.asarray(qvecs.value_lengths())).tolist():
            at, q = _unit(qvecs, dim)
            parts[dim] = [_Best(at[i : i + step], q[i : i + step], k) for i in range(0, len(at), step)]
        for rows in chunks:
            for dim, some in parts.items():
                at, x = _unit(rows["vec"].combine_chunks(), dim)
                if len(at):
                    ids = rows.select(["vector_id", "video_id"]).take(pa.array(at))
                    for p in some:
                        p.add(x, ids)
        for p in [p for some in parts.values() for p in some]:
            yield from p.rows(query_ids)

    return work


def knn(frames: DataFrame, queries: DataFrame, k: int, few: int = FEW_QUERIES, block: int = BLOCK) -> DataFrame:
    """Rows (query_id, vector_id, video_id, score, rank) of the k frames most similar to each query.

    Similarities equal to nine decimals are ordered by vector_id. k <= 0 gives none; k beyond the frames
    gives all. Null vectors, and those that aren't as long as a query, are none of its neighbours. Up to ``few`` queries
    meet the frames as a matrix product where these lie, and each batch sends its k best a query. Of more, each
    ``block`` meets all frames in one task, in the order of vector_id, and only the k best leave it.
    """
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vector_id")
    rank = lambda hits: hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    q = queries.select("query_id", F.transform("qvec", lambda x: x.cast("double")).alias("qvec")).filter("query_id is not null and qvec is not null")
    got = q.limit(few + 1).collect()
    if len(got) > few and k > 0:
        rows = frames.filter("vec is not null").select("vector_id", "video_id", "vec")
        fields = [queries.schema["query_id"], *(rows.schema[c] for c in ("vector_id", "video_id"))]
        kind = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        return meet(q, q.count(), rows, "vector_id", _block_best(k), kind, block)
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r["qvec"]) for r in got} if k > 0 else ():
        at = np.array([i for i, r in enumerate(got) if len(r["qvec"]) == dim])
        m = np.array([[np.nan if x is None else x for x in got[i]["qvec"]] for i in at.tolist()])
        by_length[dim] = (at, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), FLOOR))
    kind = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    rows = spread(frames.select("vector_id", "video_id", "vec"))
    hits = rows.mapInArrow(_nearest(by_length, k), f"__q bigint, vector_id {kind['vector_id']}, video_id {kind['video_id']}, score double")
    names = frames.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(got)], T.StructType([T.StructField("__q", T.LongType()), queries.schema["query_id"]]))
    return rank(hits.join(F.broadcast(names), "__q").select("query_id", "vector_id", "video_id", "score"))  # ``few`` rows at most


def knn_one(frames: DataFrame, qvec: list[float], k: int) -> DataFrame:
    """As ``knn`` for one vector given as a literal: a sort-and-limit per task, without a window."""
    q = F.array(*(F.lit(float(x)) for x in qvec))
    hits = frames.select("vector_id", "video_id", cosine(F.col("vec"), q).alias("score"))
    return hits.orderBy(F.desc("score"), "vector_id").limit(k)


def _summed(parts: Iterator[pd.DataFrame], keys: list[str], largest: bool, whole: bool) -> Iterator[pd.DataFrame]:
    """Rows (keys..., total, weight) summed by key (or the componentwise maximum) within each batch; with
    ``whole``, rows come sorted by key and a key that goes on in the next batch is held back."""
    held = None
    for pdf in parts:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        held = None
        size = pdf.total.str.len()
        for dim in sorted(size.dropna().unique()):
            one = pdf[size == dim]
            code, first = one.groupby([*keys], dropna=False, sort=False).ngroup().to_numpy(), ~one.duplicated(keys).to_numpy()
            x = np.stack(one.total.to_numpy()).astype(float)
            total = np.full((int(first.sum()), int(dim)), -np.inf if largest else 0.0)
            (np.maximum if largest else np.add).at(total, code, x)
            out = one[first][keys].assign(total=list(total), weight=np.bincount(code, one.weight.to_numpy()))
            if whole and len(out):
                held = out.iloc[-1:] if held is None else pd.concat([held, out.iloc[-1:]])
                out = out.iloc[:-1]
            yield out
    if held is not None:
        yield held


def _pooled(frames: DataFrame, keys: list[str], weight: Column, largest: bool = False) -> DataFrame:
    """(keys..., total, weight): weighted sum (or maximum) of the vectors and sum of the weights per key.

    Vectors are summed within each task's batches before they move, one row per key and batch.
    """
    vec = F.transform("vec", lambda x: x.cast("double"))
    rows = frames.filter("vec is not null").select(*keys, (vec if largest else F.transform(vec, lambda x: x * weight)).alias("total"), weight.cast("double").alias("weight"))
    schema = rows.schema
    some = rows.mapInPandas(lambda parts: _summed(parts, keys, largest, False), schema)
    return some.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda parts: _summed(parts, keys, largest, True), schema)


def mean_pool(frames: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """(Weighted) mean vector per key, scaled to unit length: (keys..., vec).

    Null vectors are left out; a key with vectors of several lengths has a row for each.
    """
    p = _pooled(frames, keys, F.lit(1.0) if weight is None else weight)
    return p.select(*keys, normalize(F.transform("total", lambda x: x / F.col("weight"))).alias("vec"))


def max_pool(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Componentwise maximum per key, scaled to unit length."""
    return _pooled(frames, keys, F.lit(1.0), True).select(*keys, normalize(F.col("total")).alias("vec"))


def near_mean_pool(frames: DataFrame, keys: list[str], share: float | None) -> DataFrame:
    """Mean of the share of vectors closest to their key's mean, or (share None) the mean weighted by 1 / distance.

    The closest max(1, bround(n * share)) count; distances below 1e-6 weigh as 1e-6. Ties by vector_id.
    """
    mean = _pooled(frames, keys, F.lit(1.0)).select(*keys, F.transform("total", lambda x: x / F.col("weight")).alias("mean"), F.col("weight").alias("n"))
    d = F.sqrt(F.aggregate(F.zip_with("vec", "mean", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    rows = salted_join(frames, mean, keys, "inner", ["vector_id"]).filter(F.size("vec") == F.size("mean")).withColumn("d", d).drop("mean")
    if share is not None:
        place = F.row_number().over(W.partitionBy(*keys).orderBy("d", "vector_id"))
        return mean_pool(rows.withColumn("r", place).filter(F.col("r") <= F.greatest(F.lit(1), F.bround(F.col("n") * share))), keys)
    return mean_pool(rows, keys, 1 / F.greatest("d", F.lit(1e-6)))


def tiles(frames: DataFrame, n: int, overlap: int = 0) -> DataFrame:
    """Frames with the number ``seg`` of each fixed-size tile of n frames they lie in, per video in frame order.

    Tiles start every n - overlap frames; a video's last tile is the first that reaches its end.
    """
    total = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("total"))
    rows = salted_join(grouped_places(frames, ["video_id"], "frame_id", ["vector_id"], "pos"), total, ["video_id"], "inner", ["vector_id"])
    step = n - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - n) / F.lit(step))).cast("int")
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - (n - 1)) / F.lit(step))).cast("int")
    hi = F.least(F.floor(F.col("pos") / F.lit(step)).cast("int"), last)
    return rows.withColumn("seg", F.explode(F.sequence(lo, hi))).drop("total")


def vector_checks(frames: DataFrame) -> DataFrame:
    """One row: rows, dimensions, non-finite vectors and vectors whose norm isn't 1 within 0.01."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    off = F.abs(norm(F.col("vec")) - 1) > 0.01
    return frames.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size("vec")).cast("bigint").alias("min_dim"),
        F.max(F.size("vec")).cast("bigint").alias("max_dim"),
        F.sum(bad.cast("bigint")).alias("n_not_finite"),
        F.sum(F.coalesce(off, F.lit(True)).cast("bigint")).alias("n_not_unit"),
    )


def exact(score: Column) -> Column:
    return F.round(score, 6)
