"""Language-model scoring with weighted backoff.

Counts come from the whole training part of the corpus: every word, and every n-gram
that occurs at least LEAST times, however large the corpus. A kept n-gram has its
discounted probability; another costs the backoff weight of its context and is scored
without its first word; the lowest order is the add-one unigram. ``Automaton`` states
this as arcs and failure arcs over a table in memory.

Here its score is taken as a sum over n-grams, so that no task holds the model. With
bo(h) the log backoff weight of h (0 if nothing kept follows it), the score of a text is
that of its unigrams, plus for each kept n-gram g = h w its gain, log p(g) - bo(h) -
log p(g without its first word), plus bo(g). An n-gram that does not end in the end
token is the context of one token, and no end token is a context. Each term belongs to
one n-gram.

The model is dealt to shards by ranges of the n-grams' hashes, as many as the tokens ask
for. A worker packs the n-grams of a block of texts (sorted, delta coded) into one row a
shard; the shard's task looks them up and sends back one sum per text. Frequent words and
n-grams are a broadcast cache, and a word that occurs once in all is known from its own
text; neither changes a score.

Words and n-grams are told apart by 64-bit hashes: among 10^9 keys a chance of some 3 %
that any two are one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .spans import SpanHasher
from .substring_dedup import word_bounds

END_KEY = np.int64(0x5EED0E4D0F7E8753)  # the end token, which is no word
CHUNK = 1 << 17  # characters handled at once by a worker: their arrays stay in the processor's cache
FLUSH = 1 << 19  # n-grams, and FLUSH_TEXTS texts, that a worker gathers before it sends them on
FLUSH_TEXTS = 1 << 16
SHARD = 1_000_000  # tokens of the corpus for each shard of the model
CACHE = 250_000  # most words, and n-grams of an order, that are broadcast
SLOT_BITS = 20  # slots of an index of keys
LEAST = 2  # an n-gram seen so often is kept
_HASHER = SpanHasher()


def tokens(text: str | None) -> list[bytes]:
    """Words of a text between ASCII white space, A-Z lower-cased, without the end."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _chunks(texts: list):
    """Index ranges of about CHUNK characters; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > CHUNK:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _hashed(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, the ends included, and each token's text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw).lower(), np.uint8)
    start, end = word_bounds(data)
    until = np.cumsum([len(x) + 1 for x in raw])  # where the next text starts
    words = np.diff(np.searchsorted(start, until), prepend=0)
    doc = np.repeat(np.arange(len(texts)), words + 1)
    ids = np.full(len(doc), END_KEY)
    is_word = np.ones(len(doc), bool)
    is_word[np.cumsum(words + 1) - 1] = False
    ids[is_word] = _HASHER.spans(_HASHER.prefix(data), start, end).view(np.int64)
    return ids, doc


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def chained(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(prefix, suffix): the key of the n-gram with these two (n-1)-grams."""
    h = np.full(len(prefix), 42, np.uint64)
    for x in (prefix, suffix):
        h = (h + _P5 + np.uint64(8)) ^ (_rotl(x.view(np.uint64) * _P2, 31) * _P1)
        h = _rotl(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the keys as unsigned numbers."""
    return ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def shard_column(key: str, shards: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(key, 32) * F.lit(shards).cast("long"), 32).cast("int")


def pack(keys: np.ndarray, *numbers: np.ndarray) -> bytes:
    """Keys in ascending unsigned order as deltas, and 32-bit numbers, byte plane by byte plane."""
    n = len(keys)
    delta = np.diff(keys.view(np.uint64), prepend=np.uint64(0))
    planes = np.empty((8 + 4 * len(numbers), n), np.uint8)
    planes[:8] = delta.view(np.uint8).reshape(n, 8).T
    for i, x in enumerate(numbers):
        planes[8 + 4 * i : 12 + 4 * i] = x.astype(np.uint32).view(np.uint8).reshape(n, 4).T
    return n.to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes, numbers: int) -> list[np.ndarray]:
    n, high = int.from_bytes(blob[:8], "little"), 8 + 4 * numbers
    planes = np.frombuffer(pa.decompress(blob[8:], high * n, codec="zstd", asbytes=True), np.uint8).reshape(high, n)
    keys = np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).reshape(-1), dtype=np.uint64).view(np.int64)
    return [keys, *(np.ascontiguousarray(planes[i : i + 4].T).view(np.uint32).reshape(-1) for i in range(8, high, 4))]


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the keys (ascending) of each value of the upper SLOT_BITS bits start."""
    return np.searchsorted(keys >> np.int64(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1) - (1 << (SLOT_BITS - 1))).astype(np.int32)


def _found(keys: np.ndarray, starts: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``key`` are among the ``keys``, their places): hashes fill the slots evenly, so a
    few steps from a slot's start find each, with less waiting for memory than a binary search."""
    slot = (key >> np.int64(64 - SLOT_BITS)) + (1 << (SLOT_BITS - 1))
    pos, end = starts[slot], starts[slot + 1]
    live = np.flatnonzero(pos < end)
    hit = np.zeros(len(key), bool)
    while len(live):
        same = keys[pos[live]] == key[live]
        hit[live[same]] = True
        live = live[~same]
        pos[live] += 1
        live = live[pos[live] < end[live]]
    return hit, pos[hit]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of the keys, where each distinct key starts in it): an unstable sort, the quickest."""
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.diff(key, prepend=~key[:1]))


def _dealt(key: np.ndarray, shards: int):
    """(shard, positions) of sorted keys, shard by shard."""
    bounds = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        yield int(s), slice(bounds[s], bounds[s + 1])


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, train, total): counts in training rows and in all rows by a word's hash."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def merged():
            key, train, total = (np.concatenate(x) for x in zip(*held))
            order, start = _groups(key)
            return key[order[start]], np.add.reduceat(train[order], start), np.add.reduceat(total[order], start)

        for b in batches:
            train, texts = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                ids, doc = _hashed(texts[lo:hi])
                held.append((ids, train[lo:hi][doc], np.ones(len(ids), np.int64)))
                size += len(ids)
                if size > FLUSH:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["key", "train", "total"])
                        held.clear()
                        size = 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["key", "train", "total"])

    part = docs.select("train", "text").mapInArrow(run, "key long, train long, total long")
    return part.groupBy("key").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def key_filter(keys: DataFrame) -> np.ndarray:
    """A one-probe bit filter of fixed size; one that is full lets more keys through."""
    word = F.shiftrightunsigned("key", 6).bitwiseAND(common.FILTER_WORDS - 1)
    with common.shuffles_freed(keys.sparkSession):
        got = keys.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(common.FILTER_WORDS, np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.view(np.uint64)
    word = ((k >> np.uint64(6)) & np.uint64(common.FILTER_WORDS - 1)).astype(np.int64)
    return (bits[word] >> (k & np.uint64(63))) & np.uint64(1) > 0


def ngram_counts(docs: DataFrame, filters, n: int, shards: int) -> DataFrame:
    """(key, prefix, suffix, c) of the n-grams that occur LEAST times in training rows; prefix
    and suffix are the keys of its (n-1)-grams, which occur as often and so pass the filters."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def merged():
            prefix, suffix, num = (np.concatenate(x) for x in zip(*held))
            order, start = _groups(chained(prefix, suffix))
            return prefix[order[start]], suffix[order[start]], np.add.reduceat(num[order], start)

        def out():
            prefix, suffix, num = held[0]
            shard = shard_of(chained(prefix, suffix), shards)
            by = np.argsort(prefix.view(np.uint64))
            order = by[np.argsort(shard[by].astype(np.int16 if shards < 1 << 15 else np.int64), kind="stable")]  # 16 bits: by radix
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(bounds)):
                at = order[bounds[s] : bounds[s + 1]]
                halves = suffix[at].view(np.uint32).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack(prefix[at], *halves, num[at])], pa.binary())], names=["shard", "body"])

        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in _chunks(texts):
                ids, doc = _hashed(texts[lo:hi])
                at, key = np.arange(len(ids)), ids
                for k in range(1, n):
                    if k > 1:
                        key, at = _next(key, at, doc, k)
                    ok = _maybe(filters.value[k - 1], key)
                    key, at = key[ok], at[ok]
                pair = _neighbours(at, doc, n)
                held.append((key[pair], key[pair + 1], np.ones(len(pair), np.int64)))
                size += len(pair)
                if size > FLUSH:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield from out()
                        held.clear()
                        size = 0
        if held:
            held[:] = [merged()]
            yield from out()

    def keep(table: pa.Table) -> pa.Table:
        parts = [unpack(x, 3) for x in table.column("body").to_pylist()]
        prefix, low, high, num = (np.concatenate(x) for x in zip(*parts))
        suffix = np.ascontiguousarray(np.stack([low, high], 1)).view(np.int64).reshape(-1)
        key = chained(prefix, suffix)
        order, start = _groups(key)
        c = np.add.reduceat(num[order].astype(np.int64), start)
        at = order[start[c >= LEAST]]
        return pa.table({"key": key[at], "prefix": prefix[at], "suffix": suffix[at], "c": c[c >= LEAST]})

    part = docs.where("train").select("text").mapInArrow(run, "shard int, body binary")
    return part.groupBy("shard").applyInArrow(keep, "key long, prefix long, suffix long, c long")


def _neighbours(at: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Indices of (n-1)-grams, starting ``at`` these tokens, that form an n-gram with the next one."""
    if len(at) < 2:
        return np.zeros(0, np.int64)
    last = np.minimum(at[:-1] + n - 1, len(doc) - 1)
    return np.flatnonzero((at[1:] == at[:-1] + 1) & (doc[last] == doc[at[:-1]]))


def _next(key: np.ndarray, at: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    pair = _neighbours(at, doc, n)
    return chained(key[pair], key[pair + 1]), at[pair]


class Automaton:
    """The model of one table in memory, which ``score_documents`` is tested against.

    States are contexts; ``arcs[state * width + word]`` is (log10 p, next state).
    """

    def __init__(self, counts: list[int], total: int, vocabulary: int, grams: list[dict[tuple[int, ...], int]], discount: float):
        self.width = len(counts)
        denominator = total + vocabulary + 1
        p1 = [(c + 1) / denominator for c in counts]
        self.uni = [math.log10(p) for p in p1]
        by_context: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for level in grams:
            for g, c in level.items():
                by_context.setdefault(g[:-1], []).append((g[-1], c))
        count_of = lambda h: counts[h[0]] if len(h) == 1 else grams[len(h) - 2][h]
        seen: dict[tuple[int, ...], float] = {}
        backoff: dict[tuple[int, ...], float] = {}

        def prob(w: int, h: tuple[int, ...]) -> float:
            if not h:
                return p1[w]
            got = seen.get((*h, w))
            return got if got is not None else backoff.get(h, 1.0) * prob(w, h[1:])

        for h in sorted(by_context, key=len):
            c, taken, below = count_of(h), 0.0, 0.0
            for w, n in by_context[h]:
                p = (n - discount) / c
                seen[(*h, w)] = p
                taken += p
                below += prob(w, h[1:])
            backoff[h] = max(1 - taken, 1e-9) / max(1 - below, 1e-9)
        states = {(): 0} | {h: i for i, h in enumerate(sorted(by_context, key=lambda h: (len(h), h)), 1)}

        def longest(h: tuple[int, ...]) -> int:
            while h not in states:
                h = h[1:]
            return states[h]

        self.fail_to, self.fail_log = [0] * len(states), [0.0] * len(states)
        for h, s in states.items():
            if h:
                # contexts between h and its longest suffix that is a state weigh 1
                self.fail_to[s], self.fail_log[s] = longest(h[1:]), math.log10(backoff[h])
        self.start = [longest((w,)) for w in range(self.width)]
        self.arcs = {states[g[:-1]] * self.width + g[-1]: (math.log10(p), longest(g[1:] if len(g) > len(grams) else g)) for g, p in seen.items()}

    def traverse(self, ids: list) -> tuple[float, float]:
        """(log10 probability, unigram log10 probability) of known words; None is a word
        outside the automaton: it leads back to the root and its own term is not added."""
        arcs, uni, start, fail_to, fail_log, width = self.arcs, self.uni, self.start, self.fail_to, self.fail_log, self.width
        s, total, base = 0, 0.0, 0.0
        for w in ids:
            if w is None:
                while s:
                    total += fail_log[s]
                    s = fail_to[s]
                continue
            u = uni[w]
            base += u
            while s:
                arc = arcs.get(s * width + w)
                if arc is not None:
                    total += arc[0]
                    s = arc[1]
                    break
                total += fail_log[s]
                s = fail_to[s]
            else:
                total += u
                s = start[w]
        return total, base


def _terms(counts: DataFrame, levels: list[DataFrame], space: float, discount: float) -> list[DataFrame]:
    """A table (key, c, total, score) a level: the score that one occurrence adds to a text's.

    c is a word's count in training rows, -1 for n-grams. Each step is stored, so that the
    disk holds one join's shuffles at a time. Each join hashes its side of distinct keys, a
    shuffle partition of it at a time, so the larger side is not sorted.
    """
    p = (F.col("train") + 1) / F.lit(space)
    low = counts.where("total > 1").select("key", F.col("train").alias("c"), F.col("train").alias("seen"), "total", p.alias("p"), F.log10(p).alias("gain"))
    out: list[DataFrame] = []
    stored: list[DataFrame] = []
    for k, g in enumerate(levels, 2):
        below = common.written(g.join(low.select(F.col("key").alias("suffix"), F.col("p").alias("below")).hint("shuffle_hash"), "suffix").select("key", "prefix", "c", "below"), "lm-below")
        common.discard(g)
        mass = below.groupBy("prefix").agg(F.sum(F.col("c") - discount).alias("mass"), F.sum("below").alias("below"))
        left = lambda x: F.greatest(1 - x, F.lit(1e-9))
        bo = F.when(F.col("mass").isNotNull(), F.log10(left(F.col("mass") / F.col("seen")) / left(F.col("below"))))
        # one join gives both the terms and the contexts among them
        nodes = low.join(mass.withColumnRenamed("prefix", "key").hint("shuffle_hash"), "key", "left").withColumn("bo", bo)
        nodes = common.written(nodes.select("key", "c", "total", "seen", "bo", (F.col("gain") + F.coalesce("bo", F.lit(0.0))).alias("score")), "lm-nodes")
        out.append(common.written(nodes.select("key", "c", "total", "score"), f"lm-terms-{k - 1}"))
        context = nodes.where("bo is not null").select(F.col("key").alias("prefix"), "seen", "bo")
        p = (F.col("c") - discount) / F.col("seen")
        gain = F.log10(p) - F.col("bo") - F.log10("below")
        low = below.join(context.hint("shuffle_hash"), "prefix").select("key", F.lit(-1).cast("long").alias("c"), F.col("c").alias("seen"), F.col("c").alias("total"), p.alias("p"), gain.alias("gain"))
        low = common.written(low, f"lm-level-{k}")
        common.discard(below, nodes, *stored)
        stored = [low]
    last = low.select("key", "c", "total", F.col("gain").alias("score"))
    return [*out, last if stored else common.written(last, "lm-terms-1")]


def _frequent(terms: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows reach; counts are few, so one task orders them."""
    with common.shuffles_freed(terms.sparkSession):
        per = terms.groupBy("total").agg(F.count("*").alias("m"))
        per = per.withColumn("upto", F.sum("m").over(Window.orderBy(F.desc("total"))))
        return per.where(F.col("upto") <= most).agg(F.coalesce(F.min("total"), F.lit((1 << 62)))).first()[0]


_SUMS = ["known", "single", "base", "score"]


def score_documents(
    docs: DataFrame, train: Column, order: int = 3, cached: int = CACHE, discount: float = 0.5
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null and empty texts are the end token alone. Repeated rows and null ids are scored
    row by row; other columns are ignored. With no training row N = V = 0 and every
    token has probability 1. Texts of any length are read whole.

    Plan: counting is pre-aggregated in each task, so a hot word or n-gram is one entry per
    task. Broadcast: the ``cached`` most frequent words, and n-grams of each order, and a
    filter of 8 MB an order. An n-gram beyond the cache is one of more than ``cached`` that
    occur as often or more, so none piles up in its shard.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = common.written(word_counts(src), "lm-words")
    n, v, t = counts.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0), F.coalesce(F.sum("total"), F.lit(0))).first()
    shards, space = max(1, -(-t // SHARD)), float(n + v + 1)
    levels: list[DataFrame] = []
    filters = [key_filter(counts.where("total > 1"))]
    for k in range(2, order + 1):
        shared = sc.broadcast(filters)
        level = common.written(ngram_counts(src, shared, k, shards), f"lm-{k}-grams")
        shared.destroy()
        if level.isEmpty():
            common.discard(level)
            break
        levels.append(level)
        filters.append(key_filter(level))
    terms = _terms(counts, levels, space, discount)
    common.discard(counts)
    hot, cold = [], []
    for x in terms:
        least = _frequent(x, cached)
        hot.append(x.where(F.col("total") >= least).select("key", "c", "score"))
        cold.append(x.where(F.col("total") < least).select("key", "c", "score"))
    both = lambda parts: parts[0] if len(parts) == 1 else both([parts[0].union(parts[1]), *parts[2:]])
    top = both(hot).orderBy("key").toArrow()
    cache = sc.broadcast(tuple(top.column(i).to_numpy() for i in range(3)))
    bits = sc.broadcast(filters)

    def weights(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, base) of a term by its count; an n-gram's is -1."""
        return (c > 0).astype(np.float64), np.where(c >= 0, np.log10((np.maximum(c, 0) + 1) / space), 0.0)

    def send(batches):
        keys, c, score = cache.value
        add = dict(zip(("known", "base", "score"), (*weights(c), score)))
        starts = _starts(keys)

        def look(key, doc, sums, names):
            """Adds the cached terms to these of the texts' sums; gives the rest of the keys."""
            if not len(keys):
                return key, doc
            hit, pos = _found(keys, starts, key)
            of = doc[hit]
            for name in names:
                sums[name] += np.bincount(of, add[name][pos], len(sums[name]))
            return key[~hit], doc[~hit]

        texts_held: list[tuple] = []
        grams: list[list[tuple]] = [[], []]
        docs_held = size = 0

        def flush():
            """A row of the texts themselves, and a row of n-grams for each shard that has any."""
            names = ["doc_id", "train", "n", *_SUMS]
            columns = [pa.concat_arrays([x[i] for x in texts_held]) if i < 2 else pa.array(np.concatenate([x[i] for x in texts_held])) for i in range(1, 8)]
            block = int(texts_held[0][0])
            rows = [(block % shards, 0, _ipc(pa.RecordBatch.from_arrays(columns, names=names)))]
            for kind, held in enumerate(grams, 1):
                key, doc = (np.concatenate(x) for x in zip(*held))
                by = np.argsort(key.view(np.uint64))
                key, doc = key[by], doc[by]
                rows += [(s, kind, pack(key[at], doc[at])) for s, at in _dealt(key, shards)]
            for s, kind, body in rows:
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([body], pa.binary())], names=["shard", "block", "kind", "body"])

        for b in batches:
            uids, ids_, trains, texts = b.column(0).to_numpy(), b.column(1), b.column(2), b.column(3).to_pylist()
            for lo, hi in _chunks(texts):
                ids, doc = _hashed(texts[lo:hi])
                m = hi - lo
                sums = {x: np.zeros(m) for x in _SUMS}
                key, of = look(ids, doc, sums, add)
                ok = _maybe(bits.value[0], key)
                # a word that occurs once in all: here
                sums["single"] += np.bincount(of[~ok], minlength=m)
                grams[0].append((key[ok], of[ok] + docs_held))
                at, key = np.arange(len(ids)), ids
                for k, f in enumerate(bits.value[1:], 2):
                    key, at = _next(key, at, doc, k)
                    ok = _maybe(f, key)
                    key, at = key[ok], at[ok]
                    rest, of = look(key, doc[at], sums, ["score"])  # an n-gram's others are 0
                    grams[1].append((rest, of + docs_held))
                if len(bits.value) == 1:
                    grams[1].append((np.empty(0, np.int64), np.empty(0, np.int64)))
                texts_held.append((uids[lo], ids_.slice(lo, m), trains.slice(lo, m), np.bincount(doc, minlength=m), *sums.values()))
                docs_held += m
                size += sum(len(x[-1][0]) for x in grams) + len(ids) // 8
                if size > FLUSH or docs_held > FLUSH_TEXTS:
                    yield from flush()
                    texts_held, grams, docs_held, size = [], [[], []], 0, 0
        if texts_held:
            yield from flush()

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        """The texts' rows as they are; for each block's n-grams the sums over this shard."""
        key = right.column("key").to_numpy()
        by = np.argsort(key)
        key, c, score = key[by], right.column("c").to_numpy()[by], right.column("score").to_numpy()[by]
        known, base = weights(c)
        out: list[tuple] = []
        for block, kind, body in zip(left.column("block").to_pylist(), left.column("kind").to_pylist(), left.column("body")):
            if kind == 0:
                out.append((block, 0, body.as_py()))
                continue
            want, doc = unpack(body.as_py(), 1)
            doc = doc.astype(np.int64)
            pos = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            hit = key[pos] == want if len(key) else np.zeros(len(want), bool)
            m = int(doc.max()) + 1
            of, at = doc[hit], pos[hit]
            sums = {x: np.bincount(of, w[at], m) if kind == 1 or x == "score" else np.zeros(m) for x, w in (("known", known), ("base", base), ("score", score))}
            # words that the filter let through though they occur once; other n-grams are none of the model
            sums["single"] = np.bincount(doc[~hit], minlength=m).astype(np.float64) if kind == 1 else np.zeros(m)
            touched = np.unique(doc)
            batch = pa.RecordBatch.from_arrays([pa.array(touched), *(pa.array(sums[x][touched]) for x in _SUMS)], names=["doc", *_SUMS])
            out.append((block, 1, _ipc(batch)))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()), "body": pa.array([x[2] for x in out], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        """The rows of a block's texts."""
        got = [(kind, pa.ipc.open_stream(body).read_all()) for kind, body in zip(table.column("kind").to_pylist(), table.column("body").to_pylist())]
        own = next(x for kind, x in got if kind == 0)
        sums = {x: own.column(x).to_numpy().copy() for x in _SUMS}
        for kind, part in got:
            if kind:
                at = part.column("doc").to_numpy()
                for x in _SUMS:
                    sums[x][at] += part.column(x).to_numpy()
        trained = own.column("train").to_numpy(zero_copy_only=False).astype(bool)
        lone = sums["single"] * np.log10((trained + 1) / space)
        return pa.table({
            "doc_id": own.column("doc_id"), "held_out": pa.array(~trained), "n_tokens": own.column("n"),
            "n_known": pa.array((sums["known"] + sums["single"] * trained).astype(np.int64)), "train_tokens": pa.array(np.full(len(trained), n, np.int64)),
            "base_score": pa.array(sums["base"] + lone), "score": pa.array(sums["score"] + lone),
        })

    rows = src.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "train", "text").mapInArrow(send, "shard int, block long, kind int, body binary")
    model = both(cold).withColumn("shard", shard_column("key", shards))
    found = rows.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(resolve, "block long, kind int, body binary")
    return found.groupBy("block").applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
