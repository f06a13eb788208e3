"""Long spans that occur, identical in every character, in more than one record, by recompression.

Texts are parsed bottom-up. A round takes the symbols of the last one (at first the characters), joins
equal neighbours into runs and others into pairs, and names what came out through one dictionary for
all texts: every block of texts sends the new symbols' keys, each once, to the part of the dictionary
that owns them, where a key gets its name, or is found to occur in one text only. Names are sent back
to the blocks. Whether two symbols are joined depends on the two alone, and their joint length is
bounded in every step, so a symbol is settled by the text within ``Plan.radius`` characters of it:
equal spans consist of the same symbols but for that margin. Symbols that only one text holds can't
lie in a shared span; they are not joined further, and windows that contain one are given up.

After the last steps every window of ``span`` characters contains a whole symbol that its text alone
settles. The least-named one leads the window; windows led by one occurrence follow each other and
form a stretch. The last round names the high-level symbol about the leading one: all the settled
symbols of the last dictionary that any window it leads must contain. Texts that share a window
share this symbol, so high-level symbols in two texts or more reveal where to look. Stretches are
verified by the text itself (128 bits): if another record has all that a stretch's windows take in,
all of them are shared; if another only has the surroundings of the leading symbol, the windows are
compared one by one. Nothing else can be shared, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..skew import hot_keys, salted_join
from ..store import materialize, release
from ..tables import table
from .textarrays import blocks, code_points, mix, within

SPAN = 300
#: Longest run of one character that is one symbol.
RUN = 2
#: Longest symbols of the first steps; each later step allows half as much again.
STEPS = (RUN, 4, 4, 6, 6, 8, 8, 10, 12, 14, 16, 20, 32)
#: Longest symbols that end a round: short ones, of which there are few, and then long ones, which tell texts apart.
ROUND_ENDS = (6, 32)
#: A text is parsed in pieces of this many windows; pieces overlap, so that no window is cut.
PIECE = 1 << 19
#: Keys in a part of the dictionary.
PART = 1 << 20
_A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Plan:
    """The steps of every round for a given span.

    As many steps are taken as leave a whole symbol, settled by the window's own text, in any window, and
    half of the window to choose it from, so that stretches are long and few.
    All rounds but the last end with a dictionary, whose symbols are settled by ``below`` characters.
    """

    span: int
    rounds: tuple[tuple[int, ...], ...]
    radius: int
    longest: int
    below: int

    @property
    def width(self) -> int:
        """A window's leading symbol begins at one of so many places, from ``radius`` on."""
        return self.span - 2 * self.radius - self.longest + 1

    @staticmethod
    def of(span: int) -> Plan:
        if span < 1:
            raise ValueError("a span has one character at least")
        steps = list(STEPS)
        while steps[-1] < span:
            steps.append(steps[-1] * 3 // 2)
        taken, radius, longest = 0, 0, 1
        for k in range(1, len(steps) + 1):
            r = RUN + 1 + sum(steps[: k - 1])
            if span - 2 * r - steps[k - 1] + 1 < max(steps[k - 1], span // 2):
                break
            taken, radius, longest = k, r, steps[k - 1]
        rounds, now = [], []
        for k in range(taken):
            now.append(steps[k])
            if k == taken - 1 or (steps[k] in ROUND_ENDS and steps[k + 1] > steps[k]):
                rounds.append(tuple(now))
                now = []
        rounds = [*rounds, *[()] * (2 - len(rounds))]
        named = [x for r in rounds[:-1] for x in r]
        return Plan(span, tuple(rounds), radius, longest, RUN + 1 + sum(named[:-1]) if named else 0)


def join_symbols(names: np.ndarray, length: np.ndarray, head: np.ndarray, steps: tuple[int, ...], first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, lengths and heads (first of a text) after the steps; symbols named 0 stay as they are."""
    for k, most in enumerate(steps):
        if len(names) < 2:
            break
        if first and k == 0:  # runs: of exactly two equal characters
            same = np.zeros(len(names) + 2, bool)  # same[i]: i continues the run of i - 1
            same[1 : len(names)] = (names[1:] == names[:-1]) & ~head[1:]
            at = np.flatnonzero(same[1:-1] & ~same[:-2] & ~same[2:])
            made = mix(names[at] * np.uint64(_B) + np.uint64(2))
        else:
            side = (names * np.uint64((_B + 2 * most * 0x632BE59BD9B4E019 + 2 * k) % (1 << 64) | 1)) >> np.uint64(63)
            at = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1) & ~head[1:] & (length[1:] + length[:-1] <= most) & (names[:-1] != 0) & (names[1:] != 0))
            made = mix(names[at] * np.uint64(_A) + names[at + 1])
        if not len(at):
            continue
        names, length = names.copy(), length.copy()
        names[at] = np.maximum(made, np.uint64(1))
        length[at] += length[at + 1]
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        names, length, head = names[keep], length[keep], head[keep]
    return names, length, head


def _blob(a: np.ndarray, kind: str, packed: bool = False) -> pa.Array:
    raw = a.astype(kind).tobytes()
    return pa.array([pa.compress(raw, codec="zstd", asbytes=True) if packed else raw], pa.binary())


def _parsed(doc: pa.Array, at: np.ndarray, names: np.ndarray, length: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
    """A block: its texts, and their symbols as places in the sorted list of the block's distinct keys.

    ``several`` marks keys that more than one text of the block holds. A key's symbols are of one length,
    ``key_length``; ``dead_length`` lists the lengths of those named 0, which need no key.
    """
    keys, place = np.unique(names, return_inverse=True)
    piece = np.cumsum(head) - 1
    low, high = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    high[place] = piece  # the last one stays
    low[place[::-1]] = piece[::-1]
    known = int(len(keys) > 0 and keys[0] == 0)  # those named 0 need no name
    n = np.diff(np.append(np.flatnonzero(head), len(head)))
    docs = pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc)
    of_key = np.zeros(len(keys), np.int64)
    of_key[place] = length
    return pa.RecordBatch.from_arrays(
        [docs, _blob(at, "<i8"), _blob(n, "<i4"), _blob(place - known, "<i4", True), _blob(of_key[known:], "<u2"), _blob(length[names == 0], "<u2"), _blob(keys[known:], "<u8"), _blob((high > low)[known:], "u1")],
        names=["docs", "at", "n", "place", "key_length", "dead_length", "keys", "several"],
    )


def _block_schema(key_type: str) -> str:
    return f"docs array<{key_type}>, at binary, n binary, place binary, key_length binary, dead_length binary, keys binary, several binary"


def _begin(docs: DataFrame, plan: Plan, key_type: str) -> DataFrame:
    """Blocks of texts after the first round's joins. Long texts are cut into overlapping pieces."""
    span = plan.span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text"):
                cps, off = code_points(b.column(1))
                if len(off) > 2 or len(cps) <= PIECE + span:
                    pieces = [(cps, off, np.zeros(len(off) - 1, np.int64))]
                else:
                    cut = range(0, len(cps) - span + 1, PIECE)
                    pieces = [(p := cps[a : a + PIECE + span - 1], np.array([0, len(p)]), np.array([a])) for a in cut]
                for part, o, at in pieces:
                    head = np.zeros(len(part), bool)
                    head[o[:-1]] = True
                    names = mix(part.astype(np.uint64) + np.uint64(0x51ED270B27))
                    names, length, head = join_symbols(names, np.ones(len(part), np.int64), head, plan.rounds[0], True)
                    yield _parsed(b.column(0), at, names, length, head)

    return docs.mapInArrow(run, _block_schema(key_type))


def _dictionary(state: DataFrame) -> DataFrame:
    """Names of every block's keys, (block, names: array of (part, ranks)), from one dictionary for all blocks.

    A key's name is its part and its rank in the part; rank 0 says that one text only holds it.
    """
    total = state.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0)).alias("n")).first()["n"] // 8
    parts = max(1, -(-total // PART))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a row is a block of texts
                keys = np.frombuffer(b.column(1)[i].as_buffer(), "<u8")
                several = np.frombuffer(b.column(2)[i].as_buffer(), "u1")
                to = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                edge = np.flatnonzero(np.diff(to, prepend=-1, append=parts))
                lo, hi = edge[:-1].tolist(), edge[1:].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[edge[:-1]], pa.int32()), pa.array(np.full(len(lo), b.column(0)[i].as_py()), pa.int64()), pa.array([keys[x:y].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary()), pa.array([several[x:y].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary())],
                    names=["part", "block", "keys", "several"],
                )

    def name(t: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), "<u8")
        several = np.frombuffer(b"".join(t.column("several").to_pylist()), "u1")
        known, place, n = np.unique(keys, return_inverse=True, return_counts=True)
        shared = n > 1
        shared[place[several == 1]] = True
        rank = np.where(shared, np.cumsum(shared), 0).astype("<u4")[place]
        size = np.array([len(x) // 8 for x in t.column("keys").to_pylist()])
        edge = np.append(0, np.cumsum(size)).tolist()
        return pa.table({"part": t.column("part"), "block": t.column("block"), "ranks": pa.array([rank[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    sent = state.select("block", "keys", "several").mapInArrow(send, "part int, block bigint, keys binary, several binary")
    named = sent.groupBy("part").applyInArrow(name, "part int, block bigint, ranks binary")
    return named.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "ranks"))).alias("names"))


def _symbols(b: pa.RecordBatch, i: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, their places, and names, lengths and heads of the symbols of the i-th block; names are 0 where one text only holds the symbol."""
    raw = lambda c: b.column(b.schema.get_field_index(c))[i].as_buffer()
    packed = lambda c, kind, size: np.frombuffer(pa.decompress(raw(c), decompressed_size=size * np.dtype(kind).itemsize, codec="zstd"), kind)
    got = b.column(b.schema.get_field_index("names"))[i].values
    part = np.asarray(got.field("part")).astype(np.uint64) if got is not None else np.zeros(0, np.uint64)
    ranks = [np.frombuffer(x, "<u4") for x in got.field("ranks").to_pylist()] if got is not None else []
    rank = np.concatenate([np.zeros(0, "<u4"), *ranks]).astype(np.uint64)
    name = np.where(rank > 0, mix((np.repeat(part, [len(r) for r in ranks]) << np.uint64(32)) + rank), np.uint64(0))
    name = np.append(name, np.uint64(0))  # place -1: known to be in one text only
    n = np.frombuffer(raw("n"), "<i4").astype(np.int64)
    size = int(n.sum())
    head = np.zeros(size, bool)
    head[np.cumsum(n) - n] = True
    place = packed("place", "<i4", size)
    length = np.append(np.frombuffer(raw("key_length"), "<u2"), 0).astype(np.int64)[place]
    length[place < 0] = np.frombuffer(raw("dead_length"), "<u2")
    return b.column(b.schema.get_field_index("docs"))[i].values, np.frombuffer(raw("at"), "<i8"), name[place], length, head


def _next(state: DataFrame, steps: tuple[int, ...], key_type: str) -> DataFrame:
    """Blocks after a further round's joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a row is a block of texts
                docs, at, names, length, head = _symbols(b, i)
                yield _parsed(docs, at, *join_symbols(names, length, head, steps, False))

    return state.mapInArrow(run, _block_schema(key_type))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i up to len(x) - width."""
    n = len(x)
    pad = -n % width
    y = np.concatenate([x, np.full(pad, x.max(initial=0), x.dtype)]) if pad else x
    m = y.reshape(-1, width)
    ahead = np.minimum.accumulate(m, axis=1).reshape(-1)
    behind = np.minimum.accumulate(m[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def led_stretches(names: np.ndarray, length: np.ndarray, head: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """Stretches of windows led by one symbol: text, first and last window, leading symbol's place (within the text) and high-level symbol.

    Given are the symbols of the last dictionary. Windows that contain a settled one named 0 are left out.
    """
    none = np.zeros(0, np.int64)
    begin = np.cumsum(length) - length
    size = int(length.sum())
    off = np.append(begin[head], size)
    if size < plan.span:
        return none, none, none, none, none.astype(np.uint64)
    dead = names == 0
    lo = np.clip(begin[dead] + length[dead] + plan.below - plan.span, 0, size)
    hi = np.clip(begin[dead] - plan.below + 1, 0, size)
    fine = lo < hi
    gone = np.cumsum(np.bincount(lo[fine], minlength=size + 1) - np.bincount(hi[fine], minlength=size + 1))
    row = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - plan.span + 1, 0))
    p = off[:-1][row] + within(np.bincount(row, minlength=len(off) - 1)) if len(row) else none
    ok = gone[p] == 0
    p, row = p[ok], row[ok]
    if not len(p):
        return none, none, none, none, none.astype(np.uint64)
    top, span, _ = join_symbols(names, length, head, plan.rounds[-1], False)
    bits = np.uint64(max(20, size.bit_length()))
    order = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    start = np.cumsum(span) - span
    order[start] = (mix(top) >> bits << bits) | start.astype(np.uint64)
    # The leader of window p begins in [p + radius, p + radius + width).
    lead = (_sliding_min(order, plan.width)[p + plan.radius] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (row[1:] != row[:-1]) | (p[1:] != p[:-1] + 1)
    at = np.flatnonzero(new)
    base, x = off[row[at]], lead[at]
    # The settled symbols that every window led from x contains, and where they begin.
    first = np.searchsorted(begin, x - plan.radius + plan.below)
    last = np.searchsorted(begin + length, x + plan.longest + plan.radius - plan.below, "right")
    high = _Slices(names)(first, np.maximum(last, first)) + mix((x - begin[np.minimum(first, len(begin) - 1)]).astype(np.uint64) + np.uint64(1))
    return row[at], p[at] - base, p[np.append(at[1:], len(p)) - 1] - base, x - base, high


def _stretches(state: DataFrame, plan: Plan, key_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a row is a block of texts
                docs, at, names, length, head = _symbols(b, i)
                row, lo, hi, x, high = led_stretches(names, length, head, plan)
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(row)), pa.array(high.view(np.int64)), *(pa.array((c + at[row]).astype(np.int32)) for c in (x, lo, hi))],
                    names=["doc", "symbol", "x", "lo", "hi"],
                )

    return state.mapInArrow(run, f"doc {key_type}, symbol bigint, x int, lo int, hi int")


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    return made[0], made[1]


class _Slices:
    """64-bit names of slices of an array: equal for equal slices."""

    def __init__(self, cps: np.ndarray, base: int = _A):
        values = mix(cps.astype(np.uint64) + np.uint64(0x51ED270B27))
        power, self.inverse = _powers(base, len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.total[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.total[hi] - self.total[lo]) * self.inverse[lo])


def _with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array, np.ndarray, pa.Array]]:
    """For blocks of rows (text, parts, ...): block, code points, parts of all rows, and the offset of each part's text; columns after these repeated beside the parts."""
    for whole in batches:
        for b in blocks(whole, "text"):
            cps, off = code_points(b.column(0))
            n = np.asarray(b.column(1).value_lengths()).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), n)
            yield cps, b.column(1).flatten(), off[row], row, b


def _name_stretches(texts: DataFrame, plan: Plan, key_type: str) -> DataFrame:
    """(around, whole, doc, lo, hi) of each stretch: names of what surrounds its leading symbol and of all it takes in."""
    near, far = plan.radius, plan.radius + plan.longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cps, parts, base, row, b in _with_text(batches):
            x, lo, hi = (np.asarray(parts.field(c)).astype(np.int64) for c in ("x", "lo", "hi"))
            symbol = np.asarray(parts.field("symbol")).view(np.uint64)
            around = mix(_Slices(cps, _A)(base + x - near, base + x + far) + symbol)
            full = mix(_Slices(cps, _B)(base + lo, base + hi + plan.span) + (x - lo).astype(np.uint64) * np.uint64(_A) + (hi - lo).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(around.view(np.int64)), pa.array(full.view(np.int64)), b.column(2).take(pa.array(row)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["around", "whole", "doc", "lo", "hi"])

    return texts.select("text", "parts", "doc").mapInArrow(run, f"around bigint, whole bigint, doc {key_type}, lo int, hi int")


def _name_windows(texts: DataFrame, span: int, key_type: str) -> DataFrame:
    """Each window of the stretches beside each text (around, whole, lo, hi, d1, d2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cps, parts, base, _, _ in _with_text(batches):
            lo, hi = (np.asarray(parts.field(c)).astype(np.int64) for c in ("lo", "hi"))
            slices = _Slices(cps, _B)
            # About as many windows at once as a block has characters.
            edge = np.unique(np.searchsorted(np.cumsum(hi - lo + 1), np.arange(0, int((hi - lo + 1).sum()) + PIECE, PIECE)))
            for a, z in zip([0, *edge.tolist()], [*edge.tolist(), len(lo)], strict=True):
                n = hi[a:z] - lo[a:z] + 1
                offset, which = within(n), np.repeat(np.arange(a, z), n)
                p = base[which] + lo[which] + offset
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [parts.field("around").take(take), parts.field("whole").take(take), pa.array(offset.astype(np.int32)), pa.array(slices(p, p + span).view(np.int64)), parts.field("d1").take(take), parts.field("d2").take(take)],
                    names=["around", "whole", "offset", "name", "d1", "d2"],
                )

    return texts.select("text", "parts").mapInArrow(run, f"around bigint, whole bigint, offset int, name bigint, d1 {key_type}, d2 {key_type}")


def shared_symbols(docs: DataFrame, plan: Plan, key_type: str) -> DataFrame:
    """Stretches (doc, symbol, x, lo, hi) of windows whose high-level symbol occurs in another text too; docs has (doc, text)."""
    state = materialize(_begin(docs, plan, key_type).withColumn("block", F.monotonically_increasing_id()), "blocks")
    for steps in plan.rounds[1:-1]:
        names = _dictionary(state)
        grown = materialize(_next(state.drop("keys", "several").join(names, "block", "left"), steps, key_type).withColumn("block", F.monotonically_increasing_id()), "blocks")
        release(state)
        state = grown
    led = materialize(_stretches(state.drop("keys", "several").join(_dictionary(state), "block", "left"), plan, key_type), "stretches")
    release(state)
    # The last dictionary: high-level symbols that two texts hold.
    both = led.groupBy("symbol").agg(F.min("doc").alias("d1"), F.max("doc").alias("d2")).filter("d1 <> d2").select("symbol")
    out = materialize(salted_join(led, both, ["symbol"], "left_semi", ["doc", "lo"], hot_keys(led, ["symbol"])), "stretches")
    release(led)
    return out


def shared_intervals(df: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """Rows (doc, s, e): characters s to e of the record's text lie in spans that another record holds too.

    Intervals of a record may overlap. Null keys, null texts and texts shorter than ``span`` give none;
    spans that only recur within one record don't count. Any span of one character or more is exact.
    """
    plan = Plan.of(span)
    key_type = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= span))
    led = shared_symbols(docs, plan, key_type)
    # Written, so that Spark knows its size: few stretches are sent to the texts, many meet them in a shuffle.
    listed = materialize(led.groupBy("doc").agg(F.collect_list(F.struct("symbol", "x", "lo", "hi")).alias("parts")), "listed")  # bounded by the length of one text
    named = materialize(_name_stretches(docs.join(listed, "doc"), plan, key_type), "named")
    release(led, listed)
    both = materialize(named.groupBy("around").agg(F.min("doc").alias("d1"), F.max("doc").alias("d2")).filter("d1 <> d2").select("around"), "around")
    hot = hot_keys(named, ["around"])
    near = materialize(salted_join(named, both, ["around"], "left_semi", ["doc", "lo"], hot), "near")
    release(named, both)
    groups = materialize(near.groupBy("around", "whole").agg(F.min("doc").alias("d1"), F.max("doc").alias("d2"), F.min(F.struct("doc", "lo", "hi")).alias("one")), "groups")
    full = salted_join(near, groups.filter("d1 <> d2").select("around", "whole"), ["around", "whole"], "left_semi", ["doc", "lo"], hot)
    out = full.select("doc", F.col("lo").alias("s"), (F.col("hi") + span).alias("e"))

    alone = groups.filter("d1 = d2").select("around").distinct()
    compare = salted_join(groups, alone, ["around"], "left_semi", ["whole"], hot)
    compare = compare.select(F.col("one.doc").alias("doc"), F.struct("around", "whole", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), "d1", "d2").alias("part"))
    parts = materialize(compare.groupBy("doc").agg(F.collect_list("part").alias("parts")), "listed")  # bounded by the length of one text
    windows = materialize(_name_windows(docs.join(parts, "doc"), span, key_type), "windows")
    common = windows.groupBy("around", "name").agg(F.min("d1").alias("d1"), F.max("d2").alias("d2")).filter("d1 <> d2").select("around", "name")
    mine = windows.filter("d1 = d2").select("around", "whole", "offset", "name")
    found = salted_join(mine, common, ["around", "name"], "left_semi", ["whole", "offset"], hot_keys(mine, ["around", "name"]))
    # Neighbouring offsets of a stretch as one interval; a stretch has fewer windows than its symbol and span have characters.
    step = F.col("offset") - F.row_number().over(W.partitionBy("around", "whole").orderBy("offset"))
    found = found.distinct().withColumn("step", step).groupBy("around", "whole", "step").agg(F.min("offset").alias("a"), F.max("offset").alias("z"))
    some = salted_join(near, found, ["around", "whole"], "inner", ["doc", "lo"], hot)
    return out.unionByName(some.select("doc", (F.col("lo") + F.col("a")).alias("s"), (F.col("lo") + F.col("z") + span).alias("e")))


def shared_chars(df: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """Rows (key, shared_chars): how many characters of each record lie in a span of at least ``span``
    characters that occurs in another record too. Records without any are left out."""
    upto = W.partitionBy("doc").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    spans = shared_intervals(df, key, text, span).groupBy("doc", "s").agg(F.max("e").alias("e"))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(upto), F.lit(0))))
    return spans.withColumn("new", new).groupBy(F.col("doc").alias(key)).agg(F.sum("new").cast("bigint").alias("shared_chars"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_chars(table(spark, d, "documents"), "doc_id", "text")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the number and the share of its characters that are found elsewhere."""
    docs = table(spark, d, "documents")
    found = materialize(p10_found(spark, d), "shares")
    n = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    return docs.select("doc_id", F.length("text").alias("n")).join(found, "doc_id", "left").select("doc_id", n.alias("shared_chars"), F.round(n / F.nullif("n", F.lit(0)), 6).alias("share"))


_SHARED_SQL = f"""WITH g AS (SELECT doc_id, i, hash(substr(text, i, {SPAN})) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - {SPAN - 2})) AS i FROM documents WHERE length(text) >= {SPAN})),
m AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS step FROM g WHERE h IN (SELECT h FROM m)),
f AS (SELECT doc_id, CAST(sum(least({SPAN}, coalesce(step, {SPAN}))) AS BIGINT) AS shared_chars FROM p GROUP BY 1)
"""
QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares}
SQL = {
    "p10_found": _SHARED_SQL + "SELECT doc_id, shared_chars FROM f",
    "p10_shares": _SHARED_SQL + "SELECT doc_id, coalesce(shared_chars, 0) AS shared_chars, round(coalesce(shared_chars, 0) / nullif(length(text), 0), 6) AS share FROM documents LEFT JOIN f USING (doc_id)",
}
