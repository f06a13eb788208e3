"""Held-out passages inside documents: a prefix-filtered join of word shingles with exact verification.

A document holds ``run`` consecutive words of an item exactly if it holds all of the run - w + 1
consecutive w-word shingles of one of the item's windows of ``run`` words. All of them have to be
there, so by the prefix-filter rule one necessary token per window is enough: its rarest shingle.

1. Items become a table of shingles and their places.
2. One pass over all documents finds where they hold shingles of items. A bitmap of fixed size lets
   most others go where the text is read; what passes it is joined with the items' shingles.
3. Every window's shingles are ordered by the number of documents that hold them; the rarest is the
   window's prefix token. Joining on those aligns windows and documents.
4. Along each alignment the shingles found must follow each other for a whole window: the length and
   positional bounds, and the exact check, word for word. Words are compared by 64-bit names.

Nothing grows with the number of items but tables; only the bitmap (2 MB) is sent to the tasks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..skew import hot_keys, salted_join
from ..store import materialize, release
from ..tables import table
from .canon import LETTERS, canon, canonical_sql, look_alikes
from .textarrays import blocks, code_points, mix

RUN = 15
SHINGLE = 5
#: Bits of a shingle's name that address the bitmap.
BITS = 24


class _WordClass:
    """Whether a code point belongs to a word: letters, digits and marks that stand on a letter."""

    def __init__(self) -> None:
        self.of = np.full(0x110000, 2, np.uint8)

    def __call__(self, cps: np.ndarray) -> np.ndarray:
        c = self.of[cps]
        if len(c) and c.max() == 2:
            for cp in np.unique(cps[c == 2]).tolist():
                self.of[cp] = unicodedata.category(chr(cp))[0] in "LNM"
            c = self.of[cps]
        return c.astype(bool)


@lru_cache(maxsize=1)
def _words_of() -> _WordClass:
    return _WordClass()


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def words(texts: pa.Array, alike: tuple[str, str] = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the words of all rows, and the n + 1 offsets of the rows in them.

    Words are runs of letters and digits of the canonical text, letter case ignored.
    """
    cps, off = canon(True, alike)(*code_points(texts))
    if not len(cps):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = _words_of()(cps)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edge = off[(off > 0) & (off < len(cps))]
    cut = np.zeros(len(cps), bool)
    cut[edge] = True
    begin = np.flatnonzero(inside & (~before | cut))
    after = np.empty_like(inside)
    after[-1] = True
    after[:-1] = ~inside[1:] | cut[1:]
    end = np.flatnonzero(inside & after) + 1
    power, inverse = _powers(1 << max(20, int(len(cps)).bit_length()))
    total = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(0x1D872B41)) * power[: len(cps)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin]), np.searchsorted(begin, off)


def shingles(names: np.ndarray, off: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all w-word shingles by the index of their first word, and whether one lies within a row."""
    n = len(names) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = names[:n].copy()
    for k in range(1, w):
        h = h * np.uint64(0x9E3779B97F4A7C15) + names[k : k + n]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return mix(h), row[:n] == row[w - 1 : w - 1 + n]


def _item_shingles(items: DataFrame, run: int, w: int) -> DataFrame:
    """(item, pos, shingle) of all items with ``run`` words or more."""
    alike = look_alikes(items.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text"):
                names, off = words(b.column(1), alike)
                h, inside = shingles(names, off, w)
                row = np.searchsorted(off, np.arange(len(h)), "right") - 1
                keep = np.flatnonzero(inside & (np.diff(off)[row] >= run))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[keep])), pa.array((keep - off[row[keep]]).astype(np.int32)), pa.array(h[keep].view(np.int64))], names=["item", "pos", "shingle"])

    return items.mapInArrow(go, "item bigint, pos int, shingle bigint")


def _bitmap(shingle_rows: DataFrame) -> np.ndarray:
    """2 ** BITS bits, those set at which a shingle's first bits point; at most 2 ** (BITS - 6) words come to the driver."""
    at = F.shiftrightunsigned("shingle", 64 - BITS)
    rows = shingle_rows.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).collect()
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in rows:
        out[r["word"]] = r["bits"]
    return out.view(np.uint8)


def _document_shingles(docs: DataFrame, bitmap, w: int, key_type: str) -> DataFrame:
    """(doc, pos, shingle) of all documents' shingles that pass the bitmap."""
    alike = look_alikes(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(bitmap.value, bitorder="little").astype(bool)
        for whole in batches:
            for b in blocks(whole, "text"):
                names, off = words(b.column(1), alike)
                h, inside = shingles(names, off, w)
                at = np.flatnonzero(inside & bits[h >> np.uint64(64 - BITS)])
                row = np.searchsorted(off, at, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array((at - off[row]).astype(np.int32)), pa.array(h[at].view(np.int64))], names=["doc", "pos", "shingle"])

    return docs.mapInArrow(go, f"doc {key_type}, pos int, shingle bigint")


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN, w: int = SHINGLE) -> DataFrame:
    """Rows (item_id, doc_id): the document holds at least ``run`` consecutive words of the item.

    Null keys, null and empty texts, and items shorter than ``run`` words, give no rows. Repeated
    documents and items each give their own rows; a pair comes out once. ``run`` is ``w`` at least.
    """
    if not 1 <= w <= run:
        raise ValueError("a window has as many words as a shingle at least")
    key_type = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null")
    items = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    own = materialize(_item_shingles(items, run, w), "items")
    known = own.select("shingle").distinct()
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(known))
    hits = materialize(_document_shingles(docs, bitmap, w, key_type).join(known, "shingle", "left_semi"), "hits")
    hot = hot_keys(hits, ["shingle"])

    # The rarest shingle of every window.
    n = hits.groupBy("shingle", "doc").agg(F.lit(1).alias("one")).groupBy("shingle").agg(F.count("one").alias("n"))
    size = run - w + 1
    window = W.partitionBy("item").orderBy("pos").rowsBetween(0, size - 1)
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "pos")).over(window)
    prefix = own.distinct().join(n, "shingle", "left").select("item", rare.alias("r"), F.count(F.lit(1)).over(window).alias("wide")).filter((F.col("wide") == size) & (F.col("r.n") > 0))
    prefix = prefix.select("item", "r.shingle", F.col("r.pos").alias("at")).distinct()

    # Alignments of a window and a document, and the shingles that agree along them.
    aligned = salted_join(hits, prefix, ["shingle"], "inner", ["doc", "pos"], hot).select("item", "doc", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    aligned = materialize(aligned, "aligned")
    along = hits.join(aligned, "doc").withColumn("at", F.col("pos") - F.col("shift"))
    agree = along.join(own.select("item", F.col("pos").alias("at"), "shingle"), ["item", "at", "shingle"], "left_semi").select("item", "doc", "shift", "at").distinct()
    place = F.row_number().over(W.partitionBy("item", "doc", "shift").orderBy("at"))
    runs = agree.withColumn("island", F.col("at") - place).groupBy("item", "doc", "shift", "island").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= size)
    out = materialize(runs.select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id")).distinct(), "leaks")
    release(own, hits, aligned)
    return out


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items: in how many documents each is found, by source of the documents."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    found = p9_found(spark, d)
    items = table(spark, d, "eval_items").select("item_id", "task")
    return docs.join(found, "doc_id").groupBy("item_id", "source").agg(F.count(F.lit(1)).alias("n_docs")).join(items, "item_id").select("item_id", "task", "source", "n_docs")


_WORDS_SQL = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}\\p{{M}}]+')".format(canonical_sql("text", True))
_LEAK_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS_SQL} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k : k + {RUN - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {RUN - 2})) AS k FROM d WHERE len(w) >= {RUN})),
ig AS (SELECT item_id, array_to_string(w[k : k + {RUN - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - {RUN - 2})) AS k FROM i WHERE len(w) >= {RUN})),
f AS (SELECT DISTINCT item_id, doc_id FROM dg JOIN ig USING (g))
"""
QUERIES = {"p9_found": p9_found, "p9_report": p9_report}
SQL = {
    "p9_found": _LEAK_SQL + "SELECT item_id, doc_id FROM f",
    "p9_report": _LEAK_SQL + "SELECT item_id, task, source, count(*) AS n_docs FROM f JOIN documents USING (doc_id) JOIN eval_items USING (item_id) GROUP BY ALL",
}
