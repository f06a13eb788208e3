"""One form for texts that look the same but differ in their characters.

Text is worked on as flat arrays of code points: a lookup table gives each code point's expansion
(possibly empty), offsets place the expansions, combining marks are put into canonical order by one
sort and composed with their base letters round by round. No string call is made per row or per
character; the table's entries are made once per distinct code point of a worker's life.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..skew import hot_keys, salted_join
from ..store import materialize
from ..tables import table
from .textarrays import blocks, code_points, to_strings, within

# Letters that print as the Latin letter below them. Used by the SQL that results are compared with
# and where no list is given, never in place of the public table below; the last three are Latin letters of other alphabets.
LETTERS = (
    "АВЕЅІЈКМНОРСТУХ" "аеѕіјорсухһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ονϳ" "ÐƉɡ",
    "ABESIJKMHOPCTYX" "aesijopcyxhdqw" "ABEZHIKMNOPTYX" "ovj" "ĐĐg",
)
#: Kinds of compatibility forms that don't change what a reader sees.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Not shown at all, besides format characters: grapheme joiner, Hangul fillers, Mongolian and other variation selectors.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Format characters that are shown.
SHOWN_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}


@lru_cache(maxsize=1)
def _confusables(spark: SparkSession) -> tuple[str, str]:
    """Letters with case that Unicode's table of confusables shows as an ASCII letter of the same case, and these.

    The table (confusables.txt of Unicode Technical Standard 39, under the Unicode License) is the one in
    the ICU library that Spark brings along; of ICU 77, with Unicode 16, 142 letters come out. Digits and
    signs, Latin letters and letters without case are left out: they read as what they are.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    points = [cp for lo, hi in ((0x41, 0x2E00), (0xA640, 0xABC0), (0x10400, 0x10600), (0x1E900, 0x1E944)) for cp in range(lo, hi) if unicodedata.category(chr(cp)) in ("Lu", "Ll")]
    shown = checker.getSkeleton("\n".join(map(chr, points))).split("\n")
    latin = {(x, unicodedata.category(chr(cp))): chr(cp) for cp, x in zip(points, shown, strict=True) if cp < 0x80}
    src = dst = ""
    for cp, x in zip(points, shown, strict=True):
        ch, like = chr(cp), latin.get((x, unicodedata.category(chr(cp))))
        if like and cp >= 0x80 and "LATIN" not in unicodedata.name(ch, "") and not unicodedata.decomposition(ch):
            src, dst = src + ch, dst + like
    return src + LETTERS[0][-3:], dst + LETTERS[1][-3:]


def look_alikes(spark: SparkSession) -> tuple[str, str]:
    """Look-alike letters and the letters they are taken for.

    Where the table can't be read (a session over Spark Connect, or a JVM without ICU) that is an error: with
    fewer letters texts that look the same would be kept apart, and nothing in the result would tell.
    """
    try:
        return _confusables(spark)
    except Exception as e:
        raise RuntimeError("the table of look-alike letters can't be read: it needs a session with a JVM that holds com.ibm.icu.text.SpoofChecker") from e


def _expansion(cp: int, fold_case: bool, alike: Mapping[str, str]) -> list[int]:
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if cp in INVISIBLE or (kind == "Cf" and cp not in SHOWN_FORMAT):
        return []
    if kind == "Zs":
        return [0x20]
    ch = alike.get(ch, ch)
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0].startswith("<"):
        tag, parts = parts[0], parts[1:]
        if tag not in SAME_LOOK and not (tag == "<compat>" and (kind[0] == "L" or kind == "Nl")):
            parts = []
    if parts:
        return [x for p in parts for x in _expansion(int(p, 16), fold_case, alike)]
    if fold_case and (low := ch.lower()) != ch:
        return [x for c in low for x in _expansion(ord(c), fold_case, alike)]
    return [ord(ch)]


@lru_cache(maxsize=1)
def _pairs() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (first << 21 | second) of primary composites, and the composites."""
    found = {}
    for cp in range(0xA0, 0x30000):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            found[int(parts[0], 16) << 21 | int(parts[1], 16)] = cp
    keys = np.array(sorted(found), np.int64)
    return keys, np.array([found[k] for k in keys.tolist()], np.int64)


def _composite(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The composite of each pair, 0 where there is none."""
    keys, values = _pairs()
    want = first.astype(np.int64) << 21 | second.astype(np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    out = np.where(keys[at] == want, values[at], 0)
    lv = (first >= 0x1100) & (first < 0x1113) & (second >= 0x1161) & (second < 0x1176)
    lvt = (first >= 0xAC00) & (first < 0xD7A4) & ((first.astype(np.int64) - 0xAC00) % 28 == 0) & (second > 0x11A7) & (second < 0x11C3)
    f, s = first.astype(np.int64), second.astype(np.int64)
    return np.where(lv, 0xAC00 + ((f - 0x1100) * 21 + s - 0x1161) * 28, np.where(lvt, f + s - 0x11A7, out))


class Canon:
    """Canonical form of code-point arrays; ``fold_case`` ignores letter case too."""

    def __init__(self, fold_case: bool = False, alike: tuple[str, str] = LETTERS):
        self.fold_case = fold_case
        self.alike = dict(zip(*alike, strict=True))
        self.start = np.full(0x110000, -1, np.int32)
        self.length = np.zeros(0x110000, np.uint8)
        self.single = np.zeros(0x110000, np.uint32)
        self.ccc = np.zeros(0x110000, np.uint8)
        self.joins = np.zeros(0x110000, bool)  # of class 0, yet second in a composite
        self.joins[_pairs()[0] & 0x1FFFFF] = True
        self.joins[0x1161:0x1176] = self.joins[0x11A8:0x11C3] = True
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, cps: np.ndarray) -> None:
        unknown = cps[self.start[cps] < 0]
        if not len(unknown):
            return
        more = [self.flat]
        at = len(self.flat)
        for cp in np.unique(unknown).tolist():
            x = np.array(_expansion(cp, self.fold_case, self.alike), np.uint32)
            self.start[cp], self.length[cp], self.single[cp] = at, len(x), x[0] if len(x) == 1 else 0
            at += len(x)
            more.append(x)
            for y in x.tolist():
                self.ccc[y] = unicodedata.combining(chr(y))
        self.flat = np.concatenate(more)

    def __call__(self, cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Canonical code points and row offsets."""
        self._learn(cps)
        n = self.length[cps]
        if len(cps) and n.min() == n.max() == 1:
            out = self.single[cps]
        else:
            n = n.astype(np.int64)
            at = np.zeros(len(cps) + 1, np.int64)
            np.cumsum(n, out=at[1:])
            out = self.flat[np.repeat(self.start[cps], n) + within(n)] if len(cps) else cps
            off = at[off]
        return self._compose(out, off)

    def _compose(self, a: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(a):
            return a, off
        ccc = self.ccc[a]
        keep = np.ones(len(a), bool)
        if ccc.any():
            first = np.zeros(len(a) + 1, bool)
            first[off] = True
            first = first[:-1]
            starter = (ccc == 0) | first
            # Only marks and the letters before them are touched.
            mark = np.flatnonzero(~starter | (ccc > 0))
            run = np.cumsum(starter)
            if len(mark) > 1:
                key = run[mark].astype(np.int64) << 8 | ccc[mark]
                if (np.diff(key) < 0).any():
                    a = a.copy()
                    a[mark] = a[mark[np.argsort(key, kind="stable")]]
                    ccc = self.ccc[a]
            mark = np.flatnonzero(~starter)
            heads, group = np.unique(run[mark], return_inverse=True)
            base_at = np.flatnonzero(starter)[heads - 1]
            base, last = a[base_at].astype(np.int64), np.where(ccc[base_at] > 0, 255, 0)
            rank = mark - base_at[group]
            for k in range(1, int(rank.max()) + 1 if len(rank) else 1):
                now = np.flatnonzero(rank == k)
                g, m = group[now], mark[now]
                made = np.where(last[g] < ccc[m], _composite(base[g], a[m]), 0)
                yes = made > 0
                base[g[yes]] = made[yes]
                keep[m[yes]] = False
                last[g[~yes]] = ccc[m[~yes]]
            a = a.copy() if not a.flags.writeable else a
            a[base_at] = base
            if not keep.all():
                at = np.zeros(len(a) + 1, np.int64)
                np.cumsum(keep, out=at[1:])
                a, off = a[keep], at[off]
        while True:  # pairs of two full letters, such as Hangul syllables
            can = np.flatnonzero(self.joins[a] & (self.ccc[a] == 0))
            can = can[can > 0]
            if not len(can):
                return a, off
            edge = np.zeros(len(a) + 1, bool)
            edge[off] = True
            can = can[~edge[can]]
            made = _composite(a[can - 1], a[can])
            can, made = can[made > 0], made[made > 0]
            if len(can):
                free = np.concatenate([[True], np.diff(can) > 1])
                can, made = can[free], made[free]
            if not len(can):
                return a, off
            a = a.copy()
            a[can - 1] = made
            left = np.ones(len(a), bool)
            left[can] = False
            at = np.zeros(len(a) + 1, np.int64)
            np.cumsum(left, out=at[1:])
            a, off = a[left], at[off]


@lru_cache(maxsize=2)
def canon(fold_case: bool = False, alike: tuple[str, str] = LETTERS) -> Canon:
    return Canon(fold_case, alike)


def canonical_strings(a: pa.Array, fold_case: bool = False, alike: tuple[str, str] = LETTERS) -> pa.Array:
    return to_strings(*canon(fold_case, alike)(*code_points(a)), np.asarray(a.is_valid()))


def with_canonical(df: DataFrame, text: str, out: str, fold_case: bool = False) -> DataFrame:
    """``df`` with the canonical form of column ``text`` as column ``out``; null stays null, empty stays empty.

    Rows, their order within a partition and all other columns are left as they are; a column that
    has the name ``out`` already is replaced.
    """
    df = df.drop(out) if out in df.columns and out != text else df
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    target, alike = out, look_alikes(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, text):
                made = canonical_strings(b.column(b.schema.get_field_index(text)), fold_case, alike)
                yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, target])

    return df.mapInArrow(run, ", ".join([*fields, f"`{target}` string"]))


def same_look_classes(df: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """Rows (field, key, raw, look) of texts that aren't null or blank: digests of the text and of its canonical form."""
    rows = with_canonical(df.select(F.col(field).alias("field"), F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null"), "text", "form")
    return rows.filter(F.col("form").rlike(r"\S")).select("field", "key", F.sha2("text", 256).alias("raw"), F.sha2("form", 256).alias("look"))


def same_look_pairs(df: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """Pairs (field, key_a, key_b), key_a < key_b, of texts that differ in their characters but not in their look.

    Only classes with at least two spellings are joined with themselves; a class that holds a large
    share of the rows is split over many tasks.
    """
    rows = materialize(same_look_classes(df, field, key, text), "looks")
    mixed = rows.groupBy("field", "look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi").select("field", "look")
    hot = hot_keys(rows, ["field", "look"])
    some = salted_join(rows, mixed, ["field", "look"], "left_semi", ["key"], hot)
    a = some.select("field", "look", F.col("key").alias("key_a"), F.col("raw").alias("raw_a"))
    b = some.select("field", "look", F.col("key").alias("key_b"), F.col("raw").alias("raw_b"))
    return salted_join(a, b, ["field", "look"], "inner", ["key_a"], hot).filter("key_a < key_b and raw_a <> raw_b").select("field", "key_a", "key_b")


def same_look_links(df: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """One row (field, key, class, n_links) for every text that shows the same as one that is written otherwise.

    ``class`` is the smallest key of the texts of that look, ``n_links`` how many of them are written
    otherwise. The pairs need not be made for it; a class of any size is counted before it moves.
    """
    rows = materialize(same_look_classes(df, field, key, text), "looks")
    by = ["field", "look"]
    classes = rows.groupBy(*by).agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("n"), F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi").drop("lo", "hi")
    own = rows.groupBy(*by, "raw").agg(F.count(F.lit(1)).alias("m")).join(classes, by)
    found = salted_join(rows, own, [*by, "raw"], "inner", ["key"], hot_keys(rows, [*by, "raw"]))
    return found.select("field", "key", "class", (F.col("n") - F.col("m")).alias("n_links"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c, k: table(spark, d, t).select(F.lit(f"{t}.{c}").alias("field"), F.col(k).alias("key"), F.col(c).alias("text"))
    return one("asr_sidecar", "text", "record_id").unionByName(one("kis_dev", "query", "kis_id")).unionByName(one("notebook_events", "vi_text", "event_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return same_look_pairs(_texts(spark, d), "field", "key", "text")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every text that shows the same as another one written otherwise, with its class and the number of these."""
    return same_look_links(_texts(spark, d), "field", "key", "text")


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The canonical form of every text of the three fields, null for null."""
    return with_canonical(_texts(spark, d), "text", "form").select("field", "key", "form")


def canonical_sql(text: str, fold_case: bool = False) -> str:
    """The canonical form in DuckDB's SQL, for texts of the scripts that the tables hold.

    Full-width ASCII, the f-ligatures, look-alikes, invisible characters and kinds of blanks; other
    compatibility forms are left out.
    """
    src = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + LETTERS[0]
    dst = "".join(chr(c) for c in range(0x21, 0x7F)) + LETTERS[1]
    quote = lambda x: x.replace("'", "''")
    out = f"regexp_replace(regexp_replace({text}, '[\\p{{Cf}}\\x{{34F}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g'), '\\p{{Zs}}', ' ', 'g')"
    for ligature, letters in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}.items():
        out = f"replace({out}, '{ligature}', '{letters}')"
    out = f"nfc_normalize(translate({out}, '{quote(src)}', '{quote(dst)}'))"
    return f"lower({out})" if fold_case else out


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes, "p5_canonical": p5_canonical}
_TEXTS_SQL = f"""WITH t AS (
  SELECT 'asr_sidecar.text' AS field, record_id AS key, text FROM asr_sidecar UNION ALL SELECT 'kis_dev.query', kis_id, query FROM kis_dev
  UNION ALL SELECT 'notebook_events.vi_text', event_id, vi_text FROM notebook_events),
c AS (SELECT field, key, text, {canonical_sql('text')} AS form FROM t)
"""
SQL = {
    "p5_found": _TEXTS_SQL + "SELECT a.field, a.key AS key_a, b.key AS key_b FROM c a JOIN c b ON a.field = b.field AND a.form = b.form AND a.key < b.key AND a.text <> b.text WHERE regexp_matches(a.form, '\\S')",
    "p5_classes": _TEXTS_SQL + """, g AS (SELECT field, form, min(key) AS class, count(*) AS n FROM c WHERE regexp_matches(form, '\\S') GROUP BY 1, 2 HAVING count(DISTINCT text) > 1), o AS (SELECT field, form, text, count(*) AS m FROM c GROUP BY 1, 2, 3)
SELECT field, key, class, n - m AS n_links FROM c JOIN g USING (field, form) JOIN o USING (field, form, text)""",
    "p5_canonical": _TEXTS_SQL + "SELECT field, key, form FROM c",
}
