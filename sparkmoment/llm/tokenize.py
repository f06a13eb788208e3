"""Encoding of whole tables of texts by a byte-level BPE vocabulary, vectorised over Arrow batches.

Per block of text: code points get a class each; an automaton over the classes says where a token's
run begins, its states found by an associative scan (classes stand for transition functions, the
functions' composition is one table, so chunks are scanned side by side and then chained); the
slices between the beginnings are looked up by hash in a cache of merged words, only unknown ones
are merged; the words' ids are gathered into one array. Each block is decoded and compared with its
bytes, so a hash collision can't pass.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..tables import table
from .textarrays import blocks, code_points, mix, text_buffers, to_strings, within

#: Folder of the public vocabulary files; an argument of every function here.
TOKENIZERS = os.environ.get("SPARKMOMENT_TOKENIZERS", "/opt/tokenizers")

# --- where tokens begin -------------------------------------------------------------------------
# Classes of characters, with what follows them: letter, number, other, apostrophe before one or two
# letters of a contraction, blank before a word, white space before more of it (or the end), last
# other white space before a word.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, SPACE, BREAK = range(8)
# What the last character left behind: nothing, a run of one class, a blank that the next run takes
# in, white space, a contraction with one or two letters to come.
START, IN_L, IN_N, IN_O, TAKEN, IN_S, ONE, TWO = range(8)


def _step(state: int, sym: int) -> tuple[int, bool]:
    """New state, and whether the character begins a token."""
    if sym == LETTER:
        return {TWO: ONE, ONE: START}.get(state, IN_L), state not in (IN_L, TAKEN, ONE, TWO)
    if sym in (NUMBER, OTHER):
        run = IN_N if sym == NUMBER else IN_O
        return run, state not in (run, TAKEN)
    if sym in (SHORT, LONG):
        return (IN_O, False) if state in (IN_O, TAKEN) else (ONE if sym == SHORT else TWO, True)
    if sym == SPACE:
        return IN_S, state != IN_S
    return (TAKEN if sym == BLANK else START), True


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """next state and begin flag by (state, symbol); composition table and functions of the monoid.

    Symbols 8..15 are 0..7 as first character of a text: they forget the state.
    """
    nxt = np.zeros((8, 16), np.uint8)
    begin = np.zeros((8, 16), bool)
    for s in range(8):
        for y in range(8):
            nxt[s, y], begin[s, y] = _step(s, y)
            nxt[s, y + 8], begin[s, y + 8] = _step(START, y)[0], True
    functions = [tuple(nxt[:, y].tolist()) for y in range(16)]
    known = {f: i for i, f in reversed(list(enumerate(functions)))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in functions[:16]:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(functions)
                functions.append(h)
                todo.append(h)
    then = np.zeros((len(functions), 16), np.uint16)  # running function, next symbol
    for i, f in enumerate(functions):
        for y in range(16):
            then[i, y] = known[tuple(functions[y][x] for x in f)]
    return nxt, begin, then, np.array(functions, np.uint8)


_NEXT, _BEGIN, _THEN, _FUNCTIONS = _automaton()
_WIDTH = 64


def _states(sym: np.ndarray) -> np.ndarray:
    """State before each symbol."""
    lanes = -(-len(sym) // _WIDTH)
    m = np.zeros(lanes * _WIDTH, np.uint8)
    m[: len(sym)] = sym
    m = np.ascontiguousarray(m.reshape(lanes, _WIDTH).T)
    f = m[0].astype(np.uint16)
    for j in range(1, _WIDTH):
        f = _THEN[f, m[j]]
    state, starts = START, []
    for row in _FUNCTIONS[f].tolist():
        starts.append(state)
        state = row[state]
    out = np.empty((_WIDTH, lanes), np.uint8)
    s = np.array(starts, np.uint8)
    for j in range(_WIDTH):
        out[j] = s
        s = _NEXT[s, m[j]]
    return out.T.reshape(-1)[: len(sym)]


class Classes:
    """Class of each code point: letter 0, number 1, other 2, U+0020 3, other white space 4; learnt as they appear."""

    WHITE = {*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}

    def __init__(self) -> None:
        self.of = np.full(0x110000, 255, np.uint8)
        for cp in self.WHITE:
            self.of[cp] = 4
        self.of[0x20] = 3

    def __call__(self, cps: np.ndarray) -> np.ndarray:
        c = self.of[cps]
        if len(c) and c.max() == 255:
            for cp in np.unique(cps[c == 255]).tolist():
                self.of[cp] = {"L": 0, "N": 1}.get(unicodedata.category(chr(cp))[0], 2)
            c = self.of[cps]
        return c


def token_begins(cps: np.ndarray, off: np.ndarray, classes: Classes) -> np.ndarray:
    """Indices of the code points at which a token's run begins."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    c = classes(cps)
    first = np.zeros(n + 1, bool)
    first[off] = True
    here = np.where(c < 3, c, SPACE).astype(np.uint8)
    white = c >= 3
    goes_on = np.zeros(n, bool)  # a next character in the same text that isn't white space
    goes_on[:-1] = ~white[1:] & ~first[1:n]
    here[white & goes_on] = BREAK
    here[(c == 3) & goes_on] = BLANK
    q = np.flatnonzero(cps == 0x27)
    if len(q):
        at = lambda k: np.where(q + k < n, cps[np.minimum(q + k, n - 1)], 0)
        in1 = (q + 1 < n) & ~first[np.minimum(q + 1, n)]
        in2 = in1 & (q + 2 < n) & ~first[np.minimum(q + 2, n)]
        x, y = at(1), at(2)
        here[q[in1 & np.isin(x, [ord(k) for k in "stmd"])]] = SHORT
        pair = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        here[q[in2 & pair]] = LONG
    here[first[:n]] += 8
    return np.flatnonzero(_BEGIN[_states(here), here])


# --- merging ------------------------------------------------------------------------------------
def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: bytes of a token -> id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank is merged first, the leftmost of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    nxt = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], nxt[i], alive[j] = stop, nxt[j], False
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prev[i] >= 0:
            p = prev[i]
            if (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


class Encoder:
    """Encodes blocks of text; keeps a cache of merged words between blocks.

    The cache is a direct-mapped table read with one gather; words that lose their slot are merged
    again. When it has ``max_words`` words it is begun anew, so memory has a bound and results don't
    depend on it.
    """

    SLOTS = 1 << 20
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[bytes, int], max_words: int = 1_000_000):
        self.ranks, self.max_words = ranks, max_words
        top = max(ranks.values()) + 1
        sizes = np.zeros(top, np.int64)
        for b, i in ranks.items():
            sizes[i] = len(b)
        by_id = sorted((i, b) for b, i in ranks.items())
        self.piece_len = sizes
        self.piece_at = np.cumsum(sizes) - sizes
        self.piece_bytes = np.frombuffer(b"".join(b for _, b in by_id), np.uint8)
        self.classes = Classes()
        self.byte_value = mix(np.arange(1, 257, dtype=np.uint64))
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)
        self._reset()

    def _reset(self) -> None:
        self.slot_key = np.zeros(self.SLOTS, np.uint64)
        self.slot_word = np.zeros(self.SLOTS, np.int64)
        self.ids = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.words = self.used = 0

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            m = max(n + 1, 1 << 20)
            back = np.uint64(pow(int(self.FACTOR), -1, 1 << 64))
            for name, base in (("power", self.FACTOR), ("inverse", back)):
                p = np.full(m, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def _add(self, word: bytes) -> int:
        got = merge_word(word, self.ranks)
        while self.used + len(got) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        if self.words == len(self.at):
            self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count))
        self.ids[self.used : self.used + len(got)] = got
        self.at[self.words], self.count[self.words] = self.used, len(got)
        self.used += len(got)
        self.words += 1
        return self.words - 1

    def _lookup(self, key: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        slot = (key >> np.uint64(44)).astype(np.int64)
        word = self.slot_word[slot]
        miss = np.flatnonzero(self.slot_key[slot] != key)
        if len(miss):
            u, where, back = np.unique(key[miss], return_index=True, return_inverse=True)
            which = miss[where]
            new = np.array([self._add(raw[a:b].tobytes()) for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)], np.int64)
            word[miss] = new[back]
            self.slot_key[slot[which]], self.slot_word[slot[which]] = u, new
        return word

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, the n + 1 offsets of the rows in them, and each id's first byte within the block."""
        raw, byte_off = text_buffers(texts)
        cps, off = code_points(texts)
        if len(raw) and off[-1] != np.count_nonzero((raw & 0xC0) != 0x80):  # repaired text
            texts = to_strings(cps, off)
            raw, byte_off = text_buffers(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64), np.zeros(0, np.int64)
        if self.words > self.max_words:
            self._reset()
        begins = token_begins(cps, off, self.classes)
        start = np.flatnonzero((raw & 0xC0) != 0x80)[begins] if len(cps) != len(raw) else begins
        end = np.append(start[1:], len(raw))
        self._powers(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte_value[raw] * self.power[: len(raw)], out=total[1:])
        key = mix((total[end] - total[start]) * self.inverse[start]) | np.uint64(1)
        word = self._lookup(key, raw, start, end)
        n = self.count[word]
        ids = self.ids[np.repeat(self.at[word], n) + within(n)]
        size = self.piece_len[ids]
        if size.sum() != len(raw) or not np.array_equal(self.piece_bytes[np.repeat(self.piece_at[ids], size) + within(size)], raw):
            words = [raw[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            made = {w: merge_word(w, self.ranks) for w in set(words)}
            n = np.array([len(made[w]) for w in words], np.int64)
            ids = np.array([i for w in words for i in made[w]], np.int32)
            size = self.piece_len[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids, upto[np.searchsorted(start, byte_off)], np.cumsum(size) - size


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str, shared) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(shared.value)
    return _ENCODERS[path]


def encode(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, offsets: bool = False) -> DataFrame:
    """Rows (key, ids): the token ids of ``text``, without special tokens.

    Strings that spell special tokens are ordinary text. Null and empty texts give an empty list.
    With ``offsets`` a column ``byte_starts`` tells at which byte of the UTF-8 text each token begins.
    One pass over the rows without a shuffle; the vocabulary (its file has a fixed size) is broadcast.
    """
    spark = df.sparkSession
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    shared = spark.sparkContext.broadcast(load_ranks(path))
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, shared)
        for whole in batches:
            for b in blocks(whole, "text"):
                ids, at, starts = enc(b.column(1))
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
                if offsets:
                    _, byte_off = text_buffers(b.column(1))
                    begin = starts - np.repeat(byte_off[:-1], np.diff(at))
                    lists.append(pa.ListArray.from_arrays(lists[0].offsets, pa.array(begin.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["key", "ids", *["byte_starts"] * offsets])

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {key_type}, ids array<int>" + ", byte_starts array<int>" * offsets)
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Rows (key, text) from token ids; an empty or null list gives an empty text."""
    spark = df.sparkSession
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    shared = spark.sparkContext.broadcast(load_ranks(path))
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, shared)
        for b in batches:
            lists = b.column(1)
            flat = np.asarray(lists.flatten())
            n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            size = enc.piece_len[flat]
            data = enc.piece_bytes[np.repeat(enc.piece_at[flat], size) + within(size)]
            upto = np.concatenate([[0], np.cumsum(size)])
            off = upto[np.concatenate([[0], np.cumsum(n)])]
            text = pa.Array.from_buffers(pa.large_string(), len(b), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), text.cast(pa.string())], names=["key", "text"])

    out = df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {key_type}, text string")
    return out.withColumnRenamed("key", key)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return decode(p8_ids(spark, d), "doc_id", "ids")


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded}
SQL = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
