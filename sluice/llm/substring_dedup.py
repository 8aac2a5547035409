"""Exact removal of repeated substrings by prefix-free parsing.

A text is a sequence of symbols, bytes or words (``Unit``). A rolling hash of a few
symbols that is below a threshold is a trigger; triggers cut every text into phrases,
the same way wherever the same symbols occur. The dictionary is the set of distinct
phrases, the parse the sequence of phrases of a text. A repeat of ``length`` symbols repeats its inner phrases, so

1. phrases that occur once in the dictionary rule out every window that holds one; this
   parse is of the bytes that are no white space, so one serves windows of either unit;
2. what is left is ordered by parse: a window is the suffix of one phrase, a run of
   whole phrases and the prefix of another. Windows with equal runs and equal outer
   phrases fall into one class of the corpus order, so a class that occurs twice is
   repeated as a whole, without a look at its bytes;
3. only where one run stands between different outer phrases (the edges of repeats),
   or where a window holds fewer than two triggers, are single windows compared.

The order of the corpus is needed here only up to its first ``length`` bytes, and is
held as its equivalence classes (128-bit fingerprints of the sorted runs), spread by
hash, in place of one suffix array of all the text, which no single task could hold.
``corpus_order`` gives the full suffix order of a bounded set of texts by the same
parse: suffix arrays of dictionary and parse, combined.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .near_duplicates import text_keys
from .spans import BASES, SpanHasher, mix

LENGTH = 400
_ONE, _TWO = SpanHasher(BASES[0]), SpanHasher(BASES[1])
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: ASCII white space, which stands between words.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@dataclass(frozen=True)
class Unit:
    """What a text is a sequence of: symbols of a trigger, and one trigger in so many positions."""

    trigger: int
    modulus: int
    words: bool = False

    def symbols(self, text: bytes) -> np.ndarray:
        """The bytes, or 64-bit hashes of the words between ASCII white space."""
        data = np.frombuffer(text, np.uint8)
        return _ONE.spans(_ONE.prefix(data), *word_bounds(data)) if self.words else data

    def count(self, text: Column) -> Column:
        """Number of symbols of a text column."""
        return F.regexp_count(text, F.lit(r"[^\t-\r ]+")) if self.words else F.octet_length(text)

    def inside(self, text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of bytes as spans of the symbols that lie wholly within."""
        if not self.words:
            return lo, hi
        start, end = word_bounds(np.frombuffer(text, np.uint8))
        return np.searchsorted(start, lo), np.searchsorted(end, hi, side="right")

    def least_bytes(self, length: int) -> int:
        """No text of fewer bytes has so many symbols."""
        return 2 * length - 1 if self.words else length

    def to_bytes(self, text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Runs of symbols as runs of bytes; white space within a run belongs to it."""
        if not self.words or not runs:
            return runs
        start, end = word_bounds(np.frombuffer(text, np.uint8))
        return [(int(start[a]), int(end[b - 1])) for a, b in runs]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no ASCII white space."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    space = _SPACE[data]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    turn = np.concatenate([[] if space[0] else [0], turn, [] if space[-1] else [len(data)]]).astype(np.int64)
    return turn[::2], turn[1::2]


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whole numbers of ascending, disjoint ranges, both ends included; empty ranges give none."""
    some = last >= first
    first, n = first[some], (last - first + 1)[some]
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


_YES, _NO = np.ones(1, bool), np.zeros(1, bool)


def _after(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The two in a row; texts are many and short, and np.r_ takes longer than the joining."""
    return np.concatenate([first, rest])


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans [start, end) as maximal runs, ascending; touching spans are one run."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    gap = start[1:] > end[:-1]
    return start[_after(_YES, gap)], end[_after(gap, _YES)]


#: windows of 400 bytes hold some eight triggers of bytes, windows of 50 words some six of words
BYTES, WORDS = Unit(12, 48), Unit(3, 8, words=True)
#: of the parse that rules windows out, which is of the bytes that are no white space
PARSE = Unit(12, 40)


def trigger_positions(data: np.ndarray, prefix: np.ndarray, unit: Unit = BYTES) -> np.ndarray:
    """Starts of trigger windows, ascending."""
    return np.flatnonzero(_ONE.rolling(prefix, unit.trigger) < np.uint64((1 << 64) // unit.modulus))


def bare_windows(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, unit: Unit):
    """(ordinal, start, end) in bytes of the windows that hold under two of the triggers [begin, end).

    A window whose first trigger is k holds no second one if it ends before the end of k + 1.
    """
    n = len(data)
    after = np.concatenate([end, [2 * n + length] * 2])
    if unit.words:
        start, stop = word_bounds(data)
        start, stop = start[: max(len(start) - length + 1, 0)], stop[length - 1 :]
        at = np.flatnonzero(after[np.searchsorted(begin, start) + 1] > stop)
        return at, start[at], stop[at]
    at = ranges(np.concatenate([[-1], begin]) + 1, np.minimum(np.minimum(np.concatenate([begin, [n]]), after[1:] - length - 1), n - length))
    return at, at, at + length


def parse(text: bytes, kinds: tuple = ((LENGTH, BYTES),)):
    """(hash, index, lo, hi) of the phrases of a text, and of its windows with under two triggers.

    Triggers and hashes are of the bytes that are no white space (``PARSE``), lo and hi are
    places in the whole text. Phrase i runs from trigger i to the end of trigger i + 1. A
    window whose whole phrases are a run a..b lies within (lo of a, hi of b). Windows, of
    each (length, unit) of ``kinds``, have negative indexes.
    """
    data = np.frombuffer(text, np.uint8)
    solid = np.flatnonzero(~_SPACE[data])
    prefix = _ONE.prefix(data[solid])
    t = trigger_positions(solid, prefix, PARSE)
    h = _ONE.spans(prefix, t[:-1], t[1:] + PARSE.trigger)
    begin, end = solid[t], solid[t + PARSE.trigger - 1] + 1
    # an occurrence can extend to just after the trigger before, and to just before the end of the one after
    out = [(h, np.arange(len(h)), np.concatenate([[0], begin[:-2] + 1])[: len(h)], np.concatenate([end[2:] - 1, [len(data)]])[: len(h)])]
    for kind, (length, unit) in enumerate(kinds):
        at, first, last = bare_windows(data, begin, end, length, unit)
        if len(at):
            wh = mix(_ONE.spans(prefix, np.searchsorted(solid, first), np.searchsorted(solid, last)) ^ np.uint64(0xA5A5A5A5 + kind))
            out.append(_stretches(wh, at, first, last, kind))
    return tuple(np.concatenate(c) for c in zip(*out)) if len(out) > 1 else out[0]


def _stretches(wh: np.ndarray, bare: np.ndarray, first: np.ndarray, last: np.ndarray, kind: int):
    """Rows of ``parse`` for windows of few triggers: a stretch of them is one region; its
    distinct hashes stand for it, once more (under an index of its own) where the text
    itself repeats them."""
    uniq, inv, count = np.unique(wh, return_inverse=True, return_counts=True)
    gap = bare[1:] != bare[:-1] + 1
    head = np.flatnonzero(_after(_YES, gap))
    tail = _after(head[1:], [len(bare)]) - 1
    run = np.cumsum(_after(_NO, gap))
    pair = np.unique(run * np.int64(len(uniq)) + inv)
    pr, pu = pair // len(uniq), pair % len(uniq)
    twin = count[pu] > 1
    pr, pu = np.concatenate([pr, pr[twin]]), np.concatenate([pu, pu[twin]])
    index = -1 - (2 * first[head[pr]] + kind)
    index[len(pair) :] -= 1 << 30
    return uniq[pu], index, first[head[pr]], last[tail[pr]]


def classes_of(text: bytes, regions: tuple[np.ndarray, np.ndarray], length: int = LENGTH, unit: Unit = BYTES):
    """Window classes within the regions (starts, ends, in symbols): rows (kind, run hash, class hash, first, last window start).

    The run hash is of the whole phrases and the class hash, by another base, of all the
    windows' bytes; a class is known by both. Kind 0 are such classes. Kind 1 are single
    windows with under two triggers, with two hashes of the window; where the text itself
    repeats one, a single row stands for it, and the stretches of those windows, repeated
    for certain, are kind 2.
    """
    lo, hi = (np.array(c, np.int64) for c in regions)
    hi = hi - length + 1
    lo, hi = union(lo[hi > lo], hi[hi > lo])
    p = ranges(lo, hi - 1)
    if not len(p):
        return [np.empty(0, np.int64)] * 5
    data = unit.symbols(text)
    p1, p2 = _ONE.prefix(data), _TWO.prefix(data)
    t = trigger_positions(data, p1, unit)
    before = np.zeros(len(data) + 1, np.int32)  # triggers that start before a position
    before[t + 1] = 1
    np.cumsum(before, out=before)
    i = before[p]
    j = before[p + length - unit.trigger + 1] - 1
    bare = j - i < 1
    new = _after(_YES, (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (p[1:] != p[:-1] + 1) | bare[1:] | bare[:-1])
    head = np.flatnonzero(new)
    tail = _after(head[1:], [len(p)]) - 1
    a, b = p[head], p[tail]
    lone = bare[head]
    ti = t[np.minimum(i[head], len(t) - 1)] if len(t) else np.zeros(len(head), np.int64)
    tj = t[np.maximum(j[head], 0)] + unit.trigger if len(t) else np.zeros(len(head), np.int64)
    ti, tj = np.where(lone, a, ti), np.where(lone, b + length, tj)
    shape = np.where(lone, 0, (ti - a) * 4096 + (b - a)).astype(np.uint64)
    run = _ONE.spans(p1, ti, tj).view(np.int64)
    whole = mix(_TWO.spans(p2, a, b + length) ^ shape).view(np.int64)
    cols = [lone.astype(np.int64), run, whole, a, b]
    at = np.flatnonzero(lone)
    if len(at) < 2:
        return cols
    order = at[np.lexsort((at, whole[at], run[at]))]
    same = (run[order][1:] == run[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    again = np.sort(order[_after(same, _NO) | _after(_NO, same)])
    if not len(again):
        return cols
    drop = np.zeros(len(a), bool)
    drop[order[1:][same]] = True
    head = np.flatnonzero(_after(_YES, a[again][1:] != a[again][:-1] + 1))
    tail = _after(head[1:], [len(again)]) - 1
    zero = np.zeros(len(head), np.int64)
    sure = [zero + 2, zero, zero, a[again][head], a[again][tail]]
    return [np.concatenate([c[~drop], x]) for c, x in zip(cols, sure)]


def window_hashes(text: bytes, spans: tuple[np.ndarray, np.ndarray], length: int = LENGTH, unit: Unit = BYTES):
    """(hash, hash, start) of each window that starts in [first, last] of the spans (firsts, lasts)."""
    data = unit.symbols(text)
    first, end = union(spans[0].astype(np.int64), spans[1].astype(np.int64) + 1)
    p = ranges(first, end - 1)
    return [h.spans(h.prefix(data), p, p + length).view(np.int64) for h in (_ONE, _TWO)] + [p]


def merged(spans) -> list[tuple[int, int]]:
    """Union of [start, end) spans as maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text without the (merged) spans."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def corpus_order(texts: list[bytes], unit: Unit = BYTES) -> list[tuple[int, int]]:
    """All suffixes (text, offset) of a bounded set of texts in lexicographic order.

    Prefix-free parsing: the phrases' suffixes are sorted (suffix array of the
    dictionary), the parse is sorted by phrase ranks (suffix array of the parse), and a
    suffix is ordered by the suffix of its phrase, then by the parse that follows.
    A text's end sorts before any byte; equal suffixes keep the order of their texts.
    """
    parses, words = [], set()
    for x in texts:
        data = np.frombuffer(x, np.uint8)
        t = [int(p) for p in trigger_positions(data, _ONE.prefix(data), unit) if p > 0]
        # phrases overlap by a trigger, so that no phrase suffix longer than it is a prefix of another
        ends = [p + unit.trigger for p in t]
        cuts = [(a, min(b, len(x))) for a, b in zip([0, *t], [*ends, len(x) + 1])]
        seq = [(a, x[a:b]) for a, b in cuts]
        parses.append(seq)
        words.update(s for _, s in seq)
    rank = {w: k for k, w in enumerate(sorted(words), 1)}
    # suffix array of the parse: rank sequences, by doubling
    flat = [r for seq in parses for r in [*(rank[s] for _, s in seq), 0]]
    order = np.array(flat)
    k = 1
    while k < len(flat):
        nxt = np.concatenate([order[k:], np.full(k, -1)])
        _, order = np.unique(np.stack([order, nxt], 1), axis=0, return_inverse=True)
        order = order.reshape(-1)
        k *= 2
    # suffix array of the dictionary; suffixes of at most a trigger belong to the next phrase
    tails: dict[bytes, int] = {s: k for k, s in enumerate(sorted({w[d:] for w in words for d in range(len(w) + 1)}))}
    out, at = [], 0
    for i, seq in enumerate(parses):
        for k, (a, s) in enumerate(seq):
            is_last = k == len(seq) - 1
            stop = len(s) if is_last else len(s) - unit.trigger
            for d in range(stop):
                out.append((tails[s[d:]], -1 if is_last else int(order[at + k + 1]), i, a + d))
        at += len(seq) + 1
    out.sort()
    return [(i, p) for _, _, i, p in out]


def _pairs(column):
    """(firsts, seconds) of each row of a column of lists of pairs, without a Python object a pair."""
    at = column.offsets.to_numpy()
    first, second = (column.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    return [(first[a:b], second[a:b]) for a, b in zip(at[:-1], at[1:])]


def _twice(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with two different occurrence ids: a partially aggregated min and max."""
    return rows.groupBy(*keys).agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a <> _b")


def repeated_spans(docs: DataFrame, kinds: tuple = ((LENGTH, BYTES),)):
    """(rows, texts, found): every row's identity, every distinct text, and for each (length, unit)
    of ``kinds`` the repeated windows of each distinct text.

    rows: doc_id, x1, x2, n_bytes, n0 and so on (symbols, by kind), sha (of the whole text). texts:
    x1, x2, first (a doc_id), copies, n_bytes, n0 and so on. found: x1, x2, copies, t, spans: array
    of [start, end) of symbols covered by repeated windows; texts without one are absent.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = [unit.count(F.col("text")).cast("long").alias(f"n{k}") for k, (_, unit) in enumerate(kinds)]
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(F.col("text")), text.alias("text"), F.encode(text, "UTF-8").alias("t"))
    rows = common.written(src.select("doc_id", "x1", "x2", F.octet_length("t").cast("long").alias("n_bytes"), *counts, F.sha2("t", 256).alias("sha")), "pfp-rows")
    least = min(unit.least_bytes(length) for length, unit in kinds)
    texts = rows.groupBy("x1", "x2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), *(F.max(c).alias(c) for c in ("n_bytes", *(f"n{k}" for k in range(len(kinds))))))

    def phrases(batches):
        for b in batches:
            got: list[list[np.ndarray]] = [[] for _ in range(5)]
            size = 0
            for x1, t in zip(b.column(0).to_numpy(), b.column(1).to_pylist()):
                h, index, lo, hi = parse(t, kinds)
                for c, v in zip(got, (h.view(np.int64), np.full(len(h), x1), index, lo, hi)):
                    c.append(v)
                size += len(h)
                if size > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64 if k < 2 else np.int32)) for k, c in enumerate(got)], names=names)
                    got, size = [[] for _ in range(5)], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64 if k < 2 else np.int32)) for k, c in enumerate(got)], names=names)

    # half of a text's identity will do here: were it shared by two texts, both would get
    # the regions of both, and regions are only where to look
    names = ["h", "x1", "i", "lo", "hi"]
    found = src.where(F.octet_length("t") >= least).select("x1", "t").mapInArrow(phrases, "h long, x1 long, i int, lo int, hi int")
    # stored, as the texts are parsed once and the phrases read twice
    found = common.written(found, "pfp-phrases", row_group=8 << 20)
    # copies of a text give the same occurrence id, so they do not make a phrase repeated; the
    # repeated hashes of a shuffle partition (a few bytes each, once) are hashed, so nothing is sorted
    common_h = _twice(found.select("h", F.xxhash64("x1", "i").alias("id")), ["h"]).select("h")
    kept = found.join(common_h.hint("shuffle_hash"), "h", "left_semi").groupBy("x1", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # runs of repeated phrases: index less rank is constant along a run
    w = Window.partitionBy("x1").orderBy("i")
    runs = kept.withColumn("run", F.when(F.col("i") < 0, F.col("i")).otherwise(F.col("i") - F.row_number().over(w) + F.lit(1 << 30)))
    runs = runs.groupBy("x1", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("hi") - F.col("lo") >= least)
    regions = runs.groupBy("x1").agg(F.collect_list(F.struct("lo", "hi")).alias("regions"))
    wanted = texts.join(regions.hint("shuffle_hash"), "x1").select(F.col("x1").alias("w1"), F.col("x2").alias("w2"), "first", "copies", "regions")
    wanted = common.written(wanted, "pfp-wanted")
    common.discard(found)
    near = common.thinned(src, "x1", wanted, "w1")
    # the small side is hashed in this and the later joins, so that no text is sorted
    fetched = near.join(wanted.hint("shuffle_hash"), (F.col("x1") == F.col("w1")) & (F.col("x2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("first")))
    touched = common.written(fetched.select(F.monotonically_increasing_id().alias("uid"), "x1", "x2", "first", "copies", "regions", "t"), "pfp-touched")

    spans = [_spans_of(touched, length, unit) for length, unit in kinds]
    common.discard(wanted)
    return rows, texts, spans


def _spans_of(touched: DataFrame, length: int, unit: Unit) -> DataFrame:
    """``touched`` with the spans of its repeated windows of one kind."""

    def to_classes(batches):
        for b in batches:
            for uid, regs, t in zip(b.column(0).to_pylist(), _pairs(b.column(1)), b.column(2).to_pylist()):
                cols = classes_of(t, unit.inside(t, *regs), length, unit)
                if len(cols[0]):
                    arrays = [pa.array(cols[0].astype(np.int32)), pa.array(cols[1]), pa.array(cols[2]), pa.array(np.full(len(cols[0]), uid, np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(c.astype(np.int32)) for c in cols[3:]], names=["kind", "k", "f", "uid", "a", "b"])

    least = unit.least_bytes(length)
    wide = touched.where(F.exists("regions", lambda r: r["hi"] - r["lo"] >= least))
    every = wide.select("uid", "regions", "t").mapInArrow(to_classes, "kind int, k long, f long, uid long, a int, b int")
    every = common.written(every, "pfp-classes")
    marked = every.withColumn("id", F.xxhash64("uid", "a"))
    span = (F.col("a").alias("s"), (F.col("b") + length).alias("e"))
    runs_only = marked.where("kind = 0")
    kinds = common.written(runs_only.groupBy("k", "f").agg(F.min("id").alias("id"), (F.min("id") != F.max("id")).alias("twice")), "pfp-kinds")
    by_class = runs_only.join(kinds.where("twice").select("k", "f").hint("shuffle_hash"), ["k", "f"], "left_semi").select("uid", *span)
    # runs that stand between different outer phrases, at least one of them alone
    edge = kinds.groupBy("k").agg(F.count("*").alias("c"), F.bool_or(~F.col("twice")).alias("alone")).where("c > 1 and alone")
    edge_kinds = kinds.join(edge.select("k").hint("shuffle_hash"), "k", "left_semi").select("id")
    certain = marked.where("kind = 2").select("uid", *span)
    single = marked.where("kind = 1")
    direct = single.join(_twice(single, ["k", "f"]).select("k", "f").hint("shuffle_hash"), ["k", "f"], "left_semi").select("uid", *span)
    # one occurrence of each edge class is compared window by window
    look = runs_only.select("id", "uid", "a", "b").join(edge_kinds.hint("shuffle_hash"), "id", "left_semi").groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("look"))

    def to_windows(batches):
        for b in batches:
            for uid, spans, t in zip(b.column(0).to_pylist(), _pairs(b.column(1)), b.column(2).to_pylist()):
                h1, h2, p = window_hashes(t, spans, length, unit)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.full(len(p), uid, np.int64)), pa.array(p.astype(np.int32))], names=["h1", "h2", "uid", "p"])

    windows = touched.join(look.hint("shuffle_hash"), "uid").select("uid", "look", "t").mapInArrow(to_windows, "h1 long, h2 long, uid long, p int")
    stored = common.written(windows, "pfp-windows")
    windows = stored.withColumn("id", F.xxhash64("uid", "p"))
    by_window = windows.join(_twice(windows, ["h1", "h2"]).select("h1", "h2").hint("shuffle_hash"), ["h1", "h2"], "left_semi").select("uid", F.col("p").alias("s"), (F.col("p") + length).alias("e"))
    # one kind after the other, so that the shuffle files of only one are there at a time
    gathered = []
    for part, spent in ((by_window, [stored]), (by_class.union(direct).union(certain), [every, kinds])):
        gathered.append(common.written(part.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "pfp-spans"))
        common.discard(*spent)
    spans = gathered[0].union(gathered[1]).groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return touched.join(spans.hint("shuffle_hash"), "uid")


def _cut_texts(texts: DataFrame, found: DataFrame, kind: int, length: int, unit: Unit, texts_out: bool = False) -> DataFrame:
    """x1, x2, removed, spans, left_sha, kept of each distinct text that loses any bytes."""

    def finish(batches):
        for b in batches:
            x1, x2, text = (b.column(k).to_pylist() for k in (0, 1, 3))
            removed, count, sha, kept = [], [], [], []
            for s, t in zip(_pairs(b.column(2)), text):
                runs = unit.to_bytes(t, list(zip(*(c.tolist() for c in union(*s)))))
                left = cut(t, runs)
                removed.append(len(t) - len(left))
                count.append(len(runs))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "ignore") if texts_out else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x1, pa.int64()), pa.array(x2, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                names=["x1", "x2", "removed", "spans", "left_sha", "kept"],
            )

    schema = "x1 long, x2 long, removed long, spans long, left_sha string, kept string"
    cut_texts = found.where("copies = 1").select("x1", "x2", "spans", "t").mapInArrow(finish, schema)
    # a text that occurs twice goes whole, any other as cut: one row per text to join, so that
    # both sides come straight from a shuffle and AQE can split the rows of a hot text
    twice = texts.where((F.col("copies") > 1) & (F.col(f"n{kind}") >= length))
    kept = F.lit("" if texts_out else None).cast("string").alias("kept")
    return cut_texts.union(twice.select("x1", "x2", F.col("n_bytes").alias("removed"), F.lit(1).cast("long").alias("spans"), F.lit(EMPTY_SHA).alias("left_sha"), kept))


def cuts_by_kind(docs: DataFrame, kinds: tuple, texts_out: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """(rows, cuts): the rows' identities (``repeated_spans``), and for each (length, unit) what
    each distinct text with a repeat loses (x1, x2, removed, spans, left_sha, kept). One parse
    serves all kinds; see ``remove_repeats`` for what is removed."""
    rows, texts, found = repeated_spans(docs, kinds)
    return rows, [_cut_texts(texts, f, k, *kinds[k], texts_out) for k, f in enumerate(found)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, unit: Unit = BYTES, texts_out: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``texts_out`` also
    x1, x2, the text's identity, and ``kept``, the remaining text, where anything was removed.

    Removed is each byte covered by a ``length``-byte string that also starts anywhere
    else in the table, the same row included; matches never cross rows. With the unit
    WORDS it is each run of ``length`` words that repeats, with the white space within. Null texts are
    empty. Rows with equal texts of at least ``length`` bytes are removed whole; shorter
    texts stay as they are. Exact: every window is compared by 128-bit fingerprints.
    Parts of a character that a cut leaves are dropped in ``kept``, while the digest is
    of the bytes. Other columns are ignored.

    Scale: each phrase is one shuffled row of a few integers; texts move once, those
    with repeats only are stored. Hot phrases and copies are reduced in each task first.
    """
    rows, (cuts,) = cuts_by_kind(docs, ((length, unit),), texts_out)
    out = rows.join(cuts, ["x1", "x2"], "left")
    return out.select(
        "doc_id", "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("left_sha", "sha").alias("kept_sha256"),
        *(["x1", "x2", "kept"] if texts_out else []),
    )
