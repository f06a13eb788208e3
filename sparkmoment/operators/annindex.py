"""Approximate search: an inverted file of product-quantised vectors, stored by cell, with exact re-ranking.

Fitting looks at a bounded sample; filing takes every vector to its nearest coarse centre and keeps
beside it the code of what the centre leaves over, one byte per sub-vector. Filed rows are written
partitioned by cell, so a search reads its cells' files only: codes first, then, for the best of them,
the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.vectors import dot, normalize

#: Vectors that centres and codes are fitted on, coarse centres at most, queries that recall is measured with.
FIT_ROWS, MOST_CENTRES, RECALL_QUERIES = 20_000, 1024, 200
#: Entries of a code book, at most what a byte can number, and rounds of k-means.
CODES, ROUNDS = 256, 8


@dataclass(frozen=True)
class Fitted:
    """Coarse unit centres (cells x dim) and code books (parts x codes x dim / parts)."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def parts(self) -> int:
        return self.books.shape[0]


def sample(df: DataFrame, key: str, vec: str, n: int) -> tuple[list, np.ndarray]:
    """Ids and unit vectors of at most n rows, by hash of the id, so that a retry takes the same."""
    got = df.select(key, normalize(F.col(vec)).alias("v")).orderBy(F.xxhash64(key), key).limit(n).collect()
    return [r[0] for r in got], np.array([r["v"] for r in got], float)


def _k_means(v: np.ndarray, k: int) -> np.ndarray:
    c = v[: min(k, len(v))].copy()
    for _ in range(ROUNDS):
        near = (2 * v @ c.T - (c * c).sum(1)).argmax(1)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, v)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def fit(frames: DataFrame, parts: int = 8, centres: int | None = None) -> Fitted:
    """An index fitted on FIT_ROWS vectors: sqrt(rows) centres (MOST_CENTRES at most), and code books of the rest.

    ``parts`` is lowered to a divisor of the vectors' length. Without any vector there is no centre.
    """
    _, v = sample(frames, "vector_id", "vec", FIT_ROWS)
    if not len(v):
        return Fitted(np.zeros((0, 0)), np.zeros((1, 1, 0)))
    n = centres or min(ceil(sqrt(frames.count())), MOST_CENTRES)
    c = _k_means(v, n)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    while v.shape[1] % parts:
        parts -= 1
    rest = (v - c[(v @ c.T).argmax(1)]).reshape(len(v), parts, -1)
    return Fitted(c, np.stack([_padded(_k_means(rest[:, p], CODES)) for p in range(parts)]))


def _padded(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.full((CODES - len(book), book.shape[1]), 1e6)]) if len(book) < CODES else book


def file(frames: DataFrame, index: Fitted) -> DataFrame:
    """(cell, vector_id, video_id, code, vec): every vector, at unit length, in its cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf.vec.to_numpy()).astype(float)
            cell = (v @ index.centres.T).argmax(1)
            rest = (v - index.centres[cell]).reshape(len(v), index.parts, -1)
            code = np.stack([(2 * rest[:, p] @ b.T - (b * b).sum(1)).argmax(1) for p, b in enumerate(index.books)], 1).astype("u1")
            yield pdf.assign(cell=cell.astype("int32"), code=[x.tobytes() for x in code])[["cell", "vector_id", "video_id", "code", "vec"]]

    rows = frames.select("vector_id", "video_id", normalize(F.col("vec")).alias("vec"))
    return rows.mapInPandas(run, "cell int, vector_id bigint, video_id string, code binary, vec array<double>")


def write(filed: DataFrame, path: str) -> None:
    """Store filed rows so that a search reads the files of its cells only."""
    filed.repartition("cell", F.pmod(F.xxhash64("vector_id"), F.lit(8))).sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("cell", F.col("cell").cast("int"))


def _probed(queries: DataFrame, index: Fitted, probes: int) -> DataFrame:
    """(query_id, qvec, cell) for each query's nearest cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            q = np.stack(pdf.qvec.to_numpy()).astype(float)
            cells = (-(q @ index.centres.T)).argsort(1, kind="stable")[:, :probes].astype("int32")
            yield pdf.assign(cell=list(cells)).explode("cell").astype({"cell": "int32"})

    q = queries.select("query_id", normalize(F.col("qvec")).alias("qvec"))
    return q.mapInPandas(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, qvec array<double>, cell int")


def search(filed: DataFrame, index: Fitted, queries: DataFrame, k: int, probes: int, oversample: int = 8) -> DataFrame:
    """(query_id, vector_id, video_id, score, rank): the k best by exact cosine among the k * oversample best by code
    in each query's ``probes`` nearest cells. Codes are compared within their cell, before anything moves."""

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            code = np.frombuffer(b"".join(pdf.code), "u1").reshape(len(pdf), index.parts)
            cell, q = pdf.cell.to_numpy(), np.stack(pdf.qvec.to_numpy()).astype(float)
            near = index.centres[cell] + np.concatenate([index.books[p][code[:, p]] for p in range(index.parts)], 1)
            yield pdf.assign(score=(near * q).sum(1))[["query_id", "vector_id", "cell", "score"]]

    id_type = queries.schema["query_id"].dataType.simpleString()
    probed = _probed(queries, index, probes)
    pairs = filed.select("cell", "vector_id", "code").join(probed, "cell")
    guess = pairs.mapInPandas(estimate, f"query_id {id_type}, vector_id bigint, cell int, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vector_id")
    best = guess.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k * oversample).select("query_id", "vector_id", "cell")
    exact = best.join(filed.select("cell", "vector_id", "video_id", "vec"), ["cell", "vector_id"]).join(queries.select("query_id", normalize(F.col("qvec")).alias("qvec")), "query_id")
    exact = exact.select("query_id", "vector_id", "video_id", dot(F.col("vec"), F.col("qvec")).alias("score"))
    return exact.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def probes_for(filed: DataFrame, index: Fitted, queries: DataFrame, k: int, recall: float) -> int:
    """Fewest cells to probe for the recall at k, measured against brute force with at most RECALL_QUERIES of the queries."""
    _, q = sample(queries, "query_id", "qvec", RECALL_QUERIES)
    if not len(q):
        return 1
    place = (-(q @ index.centres.T)).argsort(1, kind="stable").argsort(1, kind="stable")  # of each cell in a query's order

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v, i, cell = np.stack(pdf.vec.to_numpy()).astype(float), pdf.vector_id.to_numpy(), pdf.cell.to_numpy()
            for n, s in enumerate(q @ v.T):
                best = np.lexsort((i, -s))[:k]
                yield pd.DataFrame({"n": n, "vector_id": i[best], "score": s[best], "place": place[n, cell[best]]})

    hits = filed.select("cell", "vector_id", "vec").mapInPandas(run, "n bigint, vector_id bigint, score double, place bigint")
    w = W.partitionBy("n").orderBy(F.desc("score"), "vector_id")
    places = hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy("place").count().orderBy("place").collect()
    found, total = 0, sum(r["count"] for r in places)
    for r in places:
        found += r["count"]
        if found >= recall * total:
            return r["place"] + 1
    return len(index.centres)
