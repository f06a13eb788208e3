"""BM25 over token tables, postings, and evidence from transcripts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.text import tokens
from ..skew import grouped_last, hot_keys, spread
from ..store import materialize
from .blocks import BLOCK, meet
from .catalog import spaced

#: Okapi parameters: term saturation, length normalisation, floor of negative idf as a share of the mean.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: So many terms are named in the filter that the files are read with; it changes what is read, not what is found.
FEW_TERMS = 200
#: Queries whose postings are summed up by key; of more, blocks meet the postings.
FEW_QUERIES = 100


def term_counts(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, dl, term, tf) of every document; documents without words have no row."""
    split = spread(docs).select(key, words.alias("words"))
    return split.select(key, F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass(frozen=True)
class Bm25:
    """An index of texts by their words: built once, searched often.

    ``postings`` (term, key, dl, tf) lies sorted by term, so a search reads the stretches of its terms
    only; a frequent term's stretch is cut by key. ``terms`` has (term, df, idf), ``stats`` is one row
    (n, avgdl), over all documents, those without words included.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        self.postings.repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.parquet(f"{path}/postings")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        self.stats.coalesce(1).write.parquet(f"{path}/stats")  # one row

    @staticmethod
    def open(spark: SparkSession, path: str) -> Bm25:
        return Bm25(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats")))

    def is_empty(self) -> bool:
        return self.postings.isEmpty()


def bm25_index(docs: DataFrame, key: str, words: Column) -> Bm25:
    """The index of ``docs`` by ``words``, an array of each document's words, in the shared folder.

    idf is ln(N - n + .5) - ln(n + .5); negative ones become max(.25 * mean idf, 1e-9), zero stays.
    """
    counts = term_counts(docs, key, words).withColumnRenamed(key, "key")
    posts = materialize(counts.repartitionByRange("term", "key").sortWithinPartitions("term", "key"), "postings")
    lengths = posts.select("key", "dl").distinct().agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    stats = materialize(n.crossJoin(F.broadcast(lengths)).select("n", (F.col("words") / F.nullif("n", F.lit(0))).alias("avgdl")), "stats")  # one row each
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = materialize(df.crossJoin(F.broadcast(stats)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")), "terms")
    mean = raw.agg(F.avg("idf").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf") < 0, F.greatest(F.col("mean") * EPSILON, F.lit(1e-9))).otherwise(F.col("idf")).alias("idf"))
    return Bm25(posts, terms, stats)


def _whole_documents(chunks: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """Tables of postings sorted by key, cut where the key changes."""
    held = None
    for t in chunks:
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        at = np.asarray(t["key"].combine_chunks().dictionary_encode(null_encoding="encode").indices)
        cut = int(np.argmax(at == at[-1]))
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None:
        yield held


def _block_best(k: int):
    """Work of a block (``blocks.meet``): its queries (query_id, words) and all postings (key, term, share), sorted by key."""

    def work(asked: pa.Table, chunks: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        words = asked["words"].combine_chunks()
        flat = words.flatten()
        vocabulary = flat.field("term").unique()
        code, weight = np.asarray(pc.index_in(flat.field("term"), vocabulary)), np.asarray(flat.field("weight"))
        ends = np.cumsum(np.asarray(words.value_lengths()))
        # Queries of the same words have the same documents.
        same: dict[tuple, list[int]] = {}
        for i, (lo, hi) in enumerate(zip(ends - np.asarray(words.value_lengths()), ends)):
            same.setdefault(tuple(zip(code[lo:hi].tolist(), weight[lo:hi].tolist())), []).append(i)
        best: dict[tuple, tuple[np.ndarray, pa.Array]] = {}
        for t in _whole_documents(chunks):
            term = np.asarray(pc.fill_null(pc.index_in(t["term"].combine_chunks(), vocabulary), -1))
            by_term = np.argsort(term, kind="stable")
            lo = np.searchsorted(term[by_term], np.arange(len(vocabulary) + 1))
            keys = t["key"].combine_chunks().dictionary_encode(null_encoding="encode")
            doc, share, keys = np.asarray(keys.indices)[by_term], np.asarray(t["share"])[by_term], keys.dictionary
            for bag in same:
                total = np.zeros(len(keys))
                for c, w in bag:
                    total[doc[lo[c] : lo[c + 1]]] += w * share[lo[c] : lo[c + 1]]  # a document once a term
                score, known = best.get(bag, (np.empty(0), None))
                least = score[-1] if len(score) >= k else 0.0
                at = np.flatnonzero(total > least)
                new = np.round(total[at], 9)
                at, new = at[new > least], new[new > least]  # what equals the k-th has a later key
                if len(at) > k:
                    upper = new >= np.partition(new, len(new) - k)[len(new) - k]
                    at, new = at[upper], new[upper]
                if len(at):
                    score, some = np.concatenate([score, new]), keys.take(pa.array(at))
                    order = np.argsort(-score, kind="stable")[:k]
                    best[bag] = score[order], (some if known is None else pa.concat_arrays([known, some])).take(pa.array(order))
        found = [(i, *best[bag]) for bag in best for i in same[bag]]
        for lo in range(0, len(found), 64):
            at, scores, keys = zip(*found[lo : lo + 64])
            n = [len(x) for x in scores]
            rank = np.concatenate([np.arange(1, x + 1, dtype=np.int32) for x in n])
            ids = asked["query_id"].combine_chunks().take(pa.array(np.repeat(at, n)))
            yield pa.RecordBatch.from_arrays([ids, pa.concat_arrays(keys), pa.array(np.concatenate(scores)), pa.array(rank)], names=["query_id", "key", "score", "rank"])

    return work


def bm25_search(index: Bm25, queries: DataFrame, k: int, few: int = FEW_QUERIES, block: int = BLOCK) -> DataFrame:
    """(query_id, key, score, rank): the k documents with the highest BM25 score above 0 for each query's terms.

    ``queries`` has (query_id, term), one row for every time a term counts. Scores equal to nine decimals
    (sums come in any order) are ranked by key. Of up to ``few`` queries, a document
    found by several terms is summed up in parts before it moves, and only k documents a task and
    query are ranked. Of more, each ``block`` meets the postings of all their terms in one task, in the order of
    the key, and only the k best leave it.
    """
    q = queries.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).join(index.terms.select("term", "idf"), "term").filter("idf <> 0")
    wanted = q.select("term").distinct()
    some = wanted.limit(FEW_TERMS + 1).collect()
    # A few terms are pushed down to the files; many are joined.
    posts = index.postings.filter(F.col("term").isin([r[0] for r in some])) if len(some) <= FEW_TERMS else index.postings
    tf, share = F.col("tf"), 1 - B + B * F.col("dl") / F.col("avgdl")
    posts = posts.crossJoin(F.broadcast(index.stats))  # stats: one row
    n = q.select("query_id").distinct().count() if k > 0 else 0
    if n > few:
        words = q.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("weight")))).alias("words"))
        rows = (posts if len(some) <= FEW_TERMS else posts.join(wanted, "term", "left_semi")).select("key", "term", (tf * (K1 + 1) / (tf + K1 * share)).alias("share"))
        kind = T.StructType([T.StructField(f.name, f.dataType) for f in (words.schema["query_id"], rows.schema["key"])] + [T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        return meet(words, n, rows, "key", _block_best(k), kind, block)
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * share)
    hits = posts.join(q, "term").groupBy("query_id", "key").agg(F.round(F.sum(part), 9).alias("score")).filter("score > 0")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def one_query(spark: SparkSession, terms: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(0, t) for t in terms], "query_id bigint, term string")


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k: int) -> DataFrame:
    """As ``bm25_search`` for the terms of one query, with an index made for it: (key, score)."""
    index = bm25_index(docs, key, tokens(F.col(text)))
    return bm25_search(index, one_query(docs.sparkSession, terms), k).select(F.col("key").alias(key), "score")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key), distinct."""
    return docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))


def any_group_of_all(posts: DataFrame, key: str, groups: list[list[str]]) -> DataFrame:
    """Keys whose tokens contain every token of at least one group."""
    wanted = sorted({t for g in groups for t in g})
    have = posts.filter(F.col("token").isin(wanted)).groupBy(key).agg(F.collect_set("token").alias("have"))
    hit = F.lit(False)
    for g in groups:
        hit = hit | (F.size(F.array_except(F.array(*map(F.lit, sorted(set(g)))), "have")) == 0)
    return have.filter(hit).select(key)


def with_context(segments: DataFrame) -> DataFrame:
    """Segments with ``context``: their text between those of the neighbouring segments; blank ones are left out."""
    seq = materialize(segments.withColumns({"__o": F.struct("text"), "__back": -F.col("seg_idx")}), "segments")
    hot = hot_keys(seq, ["video_id"])
    seq = grouped_last(seq, ["video_id"], "seg_idx", (), "__o", "__b", hot, own=False)
    seq = grouped_last(seq, ["video_id"], "__back", (), "__o", "__a", hot, own=False)
    parts = F.array(F.col("__b.text"), F.col("text"), F.col("__a.text"))
    return seq.drop("__o", "__back").withColumn("context", F.array_join(F.filter(parts, lambda t: t.isNotNull() & t.rlike(r"[^\s\p{Z}]")), " ")).drop("__a", "__b")


def term_share(text: Column, terms: list[str]) -> Column:
    """Share of the terms found in the text as substrings; repeated terms count again."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0)) / F.lit(float(len(terms)))


def near_segment_scores(candidates: DataFrame, segments: DataFrame, terms: list[str], reach: int = 150) -> DataFrame:
    """(vector_id, score): best share of terms said within ``reach`` frames, times max(.3, 1 - distance / reach).

    Candidates and segments meet by video and by blocks of ``reach`` frames, three per candidate.
    """
    block = lambda c: F.floor(F.col(c) / reach).cast("bigint")
    c = candidates.select("video_id", "vector_id", "frame_id", F.explode(F.array(block("frame_id") - 1, block("frame_id"), block("frame_id") + 1)).alias("block"))
    s = segments.filter("frame is not null").select("video_id", F.col("frame"), block("frame").alias("block"), term_share(F.col("folded"), terms).alias("share")).filter("share > 0")
    d = F.abs(F.col("frame_id") - F.col("frame"))
    return c.join(s, ["video_id", "block"]).filter(d <= reach).groupBy("vector_id").agg(F.max(F.col("share") * F.greatest(F.lit(0.3), 1 - d / F.lit(float(reach)))).alias("score"))


def interval_scores(candidates: DataFrame, segments: DataFrame, terms: list[str], alpha: float = 0.01, margin: float = 2.0) -> DataFrame:
    """(vector_id, score): over the video's segments, share of terms times max(.1, exp(-alpha * distance)); outside the margin 0.3 of it.

    Inside is start - margin <= t <= end + margin, and the distance is to the middle of the segment.

    Of a video's segments outside, only a few can be a candidate's best: for each of the shares there are
    (as many as terms), the nearest middle before it and after it. They are handed along the video's
    sequence of middles and times. Segments inside are met by cells of their own length, as in ``catalog``.
    """
    s = segments.select("video_id", "start", "end", term_share(F.col("folded"), terms).alias("share"), ((F.col("start") + F.col("end")) / 2).alias("mid")).filter("share > 0")
    s = materialize(s, "said")
    t = F.col("timestamp")
    near = lambda d: F.when(d.isNotNull(), F.greatest(F.lit(0.1), F.exp(-alpha * d)))

    # Outside (and, at 0.3 of their worth, inside): nearest middles of each share on either side.
    levels = sorted(r[0] for r in s.select("share").distinct().collect())  # at most as many as terms
    seq = candidates.select("video_id", t.alias("at"), "vector_id", *(F.lit(None).cast("double").alias(f"m{i}") for i in range(len(levels))))
    mids = s.groupBy("video_id", "mid").agg(*(F.max(F.when(F.col("share") == x, F.col("mid"))).alias(f"m{i}") for i, x in enumerate(levels)))
    seq = materialize(seq.unionByName(mids.select("video_id", F.col("mid").alias("at"), F.lit(None).cast(candidates.schema["vector_id"].dataType).alias("vector_id"), *(f"m{i}" for i in range(len(levels))))), "sequence")
    hot = hot_keys(seq, ["video_id"])
    for i in range(len(levels)):
        seq = grouped_last(seq, ["video_id"], "at", ["vector_id"], f"m{i}", f"b{i}", hot)
    seq = seq.withColumn("back", -F.col("at"))
    for i in range(len(levels)):
        seq = grouped_last(seq, ["video_id"], "back", ["vector_id"], f"m{i}", f"a{i}", hot)
    worth = [x * near(F.abs(F.col("at") - F.col(f"{side}{i}"))) for i, x in enumerate(levels) for side in "ba"]
    outside = seq.filter("vector_id is not null").select("vector_id", (0.3 * F.greatest(*worth)).alias("score")) if len(worth) > 1 else None

    # Inside the margin.
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("end") - F.col("start") + 2 * margin, F.lit(1.0))))).cast("int")
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("size"))).cast("bigint")
    i = s.filter(F.col("start") - margin <= F.col("end") + margin).withColumn("size", size)
    sizes = [r[0] for r in i.select("size").distinct().collect()]  # exponents of a double
    i = i.select("video_id", "start", "end", "mid", "share", "size", F.explode(F.array_distinct(F.array(cell(F.col("start") - margin), cell(F.col("end") + margin)))).alias("cell"))
    p = candidates.select("video_id", "vector_id", "timestamp", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size")).withColumn("cell", cell(t))
    inside = p.join(i, ["video_id", "size", "cell"]).filter((t >= F.col("start") - margin) & (t <= F.col("end") + margin)).select("vector_id", (F.col("share") * near(F.abs(t - F.col("mid")))).alias("score"))
    rows = inside if outside is None else outside.filter("score is not null").unionByName(inside)
    return rows.groupBy("vector_id").agg(F.max("score").alias("score"))


def evidence(matches: DataFrame, sigma: float = 30.0) -> DataFrame:
    """Per query and video: number of matches, mean BM25, mean computed dense score, and how close the matches follow each other.

    gap is exp(-(mean gap)^2 / (2 sigma^2)) over the start times, 1 for fewer than two.
    """
    w = W.partitionBy("query_id", "video_id").orderBy("start", "match_id")
    rows = matches.withColumn("gap", F.lead("start").over(w) - F.col("start"))
    return rows.groupBy("query_id", "video_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("bm25_score").alias("bm25"),
        F.coalesce(F.avg(F.when(F.col("dense_score") > 0, F.col("dense_score"))), F.lit(0.0)).alias("dense"),
        F.coalesce(F.exp(-F.pow(F.avg("gap"), 2) / F.lit(2 * sigma**2)), F.lit(1.0)).alias("gap"),
    )


#: Weights of a video's transcript score: speech, dense, coverage, order in time, other signals.
SCORE_WEIGHTS = (0.35, 0.15, 0.25, 0.15, 0.10)


def video_scores(evid: DataFrame, coverage: Column, signals: Column) -> DataFrame:
    """Evidence with ``score``, the weighted blend clamped to 0..1; speech is min-max normalised per query (flat: 0)."""
    w = W.partitionBy("query_id")
    lo, hi = F.min("bm25").over(w), F.max("bm25").over(w)
    asr = F.when(hi - lo < 1e-9, F.lit(0.0)).otherwise((F.col("bm25") - lo) / (hi - lo))
    blend = sum((F.lit(x) * c for x, c in zip(SCORE_WEIGHTS, (asr, F.col("dense"), coverage, F.col("gap"), signals), strict=True)), F.lit(0.0))
    return evid.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend)))


def diverse_times(matches: DataFrame, most: int = 10, gap: float = 5.0) -> DataFrame:
    """(query_id, video_id, times): start times picked from the best score down, each at least ``gap`` from those picked, sorted."""
    return spaced(matches, ["query_id", "video_id"], "start", "bm25_score", "match_id", gap, most)


def feedback_terms(hits: DataFrame, text: str, stop: list[str], most: int = 3) -> DataFrame:
    """The commonest words (2 letters or more, no stop words) of the best hits, for a second search; ties by word."""
    words = hits.select(F.explode(tokens(F.col(text))).alias("term")).filter((F.length("term") >= 2) & ~F.col("term").isin(stop))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(most)


def match_signals(matches: DataFrame) -> DataFrame:
    """(query_id, video_id, asr, dense, object): mean BM25, mean of the computed dense scores, and .1 per match, in place of one."""
    dense = F.avg(F.when(F.col("dense_score") > 0, F.col("dense_score")))
    return matches.groupBy("query_id", "video_id").agg(F.avg("bm25_score").alias("asr"), F.coalesce(dense, F.lit(0.0)).alias("dense"), (0.1 * F.count(F.lit(1))).alias("object"))


def time_consistency(matches: DataFrame, strict: bool, alpha: float = 0.01, sigma: float = 30.0) -> DataFrame:
    """(query_id, video_id, consistency) of matches in the order of their starts.

    Sorted by time they are in order, so what counts is how close they follow: the gap factor, and when
    the query is ``strict`` also exp(-alpha * step) for every step between their frames, as a share of the
    frames' extent; the product over all steps is that of the way from the first to the last. A missing
    frame is taken at 30 a second. Fewer than two starts give 1; the result lies within 0 and 1.
    """
    w = W.partitionBy("query_id", "video_id").orderBy("start", "match_id")
    rows = matches.filter("start is not null").withColumns({"gap": F.lead("start").over(w) - F.col("start"), "f": F.coalesce("frame", F.floor(F.col("start") * 30).cast("bigint"))})
    at = F.struct("start", "match_id")
    way = (F.max_by("f", at) - F.min_by("f", at)) / F.nullif(F.max("f") - F.min("f"), F.lit(0))
    g = rows.groupBy("query_id", "video_id").agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("gap"), F.coalesce(way, F.lit(0.0)).alias("way"))
    value = F.exp(-F.pow("gap", F.lit(2.0)) / F.lit(2 * sigma**2))
    if strict:
        value = value * F.exp(-alpha * F.col("way"))
    return g.select("query_id", "video_id", F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).alias("consistency"))


def feedback_search(index: Bm25, texts: DataFrame, key: str, text: str, queries: Sequence[Sequence[str]], per_query: int, stop: Sequence[str], best: int = 5, first_weight: float = 1.0, second_weight: float = 0.4) -> DataFrame:
    """(key, score): a search, and a second one for the first query with the commonest words of the best hits, fused by rank.

    The constant is a fifth of the longer list, within 1 and 60. Without ``best`` hits there is no second search.
    """
    spark = texts.sparkSession
    terms = spark.createDataFrame([(i, t) for i, q in enumerate(queries) for t in q], "query_id bigint, term string")
    first = bm25_search(index, terms, per_query).groupBy("key").agg(F.max("score").alias("score"))
    first = materialize(first, "hits")
    top = first.orderBy(F.desc("score"), "key").limit(best)
    if top.count() < best:
        return first
    more = feedback_terms(texts.join(F.broadcast(top.select(F.col("key").alias(key))), key, "left_semi"), text, list(stop))  # ``best`` rows
    second = bm25_search(index, more.select(F.lit(0).cast("bigint").alias("query_id"), "term").unionByName(one_query(spark, list(queries[0]))), per_query)
    n = max(first.count(), second.count())
    ranked = lambda d, weight: d.select("key", F.row_number().over(W.orderBy(F.desc("score"), "key")).alias("rank"), F.lit(weight).alias("weight"))  # noqa: E731, lists of a search's length
    both = ranked(first, first_weight).unionByName(ranked(second, second_weight))
    return both.groupBy("key").agg(F.sum(F.col("weight") / (min(60, max(1, int(0.2 * n))) + F.col("rank"))).alias("score"))
