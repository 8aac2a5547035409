"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into parts of at most a passage's length. TF-IDF weights use
document frequencies of the items' words over all documents. A randomised SVD of the
passages of all documents and the items, whose two products with the passage matrix are
summed over tasks, gives the latent space; every passage of every document is projected into it and
compared by cosine with the parts of all items but those that the check below must
refuse there, too few of their words standing near. By falling cosine, places are checked in the text: the
longest common subsequence of words with the item, and the item's answer (its last
sentence) within the same place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Items searched at once (a broadcast of bounded size); more are searched in further blocks.
BLOCK_ITEMS, BLOCK_BYTES = 512, 2 << 20
#: words between passage starts; strides in a short and in a long passage, for item parts
#: of at most SHORT_PART words and for longer ones (cut to fit a long passage).
STRIDE, SHORT, LONG, SHORT_PART, LONG_PART = 16, 2, 4, 24, 48
#: least strides in a section of a text; sections looked at together; words after which
#: the texts read so far are searched.
SECTION, SECTIONS, WORDS = 24, 1024, 1 << 16
RANK, OVERSAMPLE = 128, 16
#: strides that a product is taken of at once; occurrences there from which a word is frequent.
PIECE, OFTEN = 2048, 17
#: words of a product whose rows are added up together.
ROWS = 256
#: cosine of a candidate (any: a bound loses places that the text check accepts); shares of the
#: item's words in order that settle it.
MIN_COSINE, SURE_LCS, MIN_LCS, MIN_ANSWER = -1.0, 0.85, 0.6, 0.6
_PUNCT = bytes.maketrans(b"".join(bytes([c]) for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits (any non-ASCII character counts as one)."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCT).split() if text else []


def _masks(a: list) -> dict:
    """The places of each element of ``a`` as bits."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    return where


def _lcs(where: dict, size: int, b) -> int:
    """Length of the longest common subsequence of ``b`` and the ``size`` elements in ``where``."""
    full = (1 << size) - 1
    v = full
    for y in b:
        m = where.get(y)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    return _lcs(_masks(a), len(a), b) if a and b else 0


@dataclass
class Items:
    """A block of benchmark items: words, answers, parts with their latent vectors."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    vocab: dict[bytes, int]
    part_item: np.ndarray | None = None
    part_long: np.ndarray | None = None
    telling: list[np.ndarray] | None = None  # an item's distinct words
    masks: list[tuple[dict, dict]] | None = None  # of an item and of its answer
    need: np.ndarray | None = None  # so many of them a place needs, or its LCS is below MIN_LCS
    first: np.ndarray | None = None  # word w is in the items holders[first[w]:first[w + 1]]
    holders: np.ndarray | None = None
    span: list[int] | None = None  # words of the stretches compared with an item
    reach: int = 0  # words of the longest item: a place's words are at most so far from its passage
    section: int = SECTION  # strides in a section of a text
    embed: np.ndarray | None = None  # idf-weighted latent vector of each vocabulary word
    parts: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> "Items":
        words = [words_of(t) for _, t in rows]
        answers = [words_of([s for s in re.split(r"(?<=[.!?])\s+", t.strip()) if words_of(s)][-1]) if w else [] for (_, t), w in zip(rows, words)]
        vocab = {w: i for i, w in enumerate(sorted({x for ws in words for x in ws}))}
        return cls([i for i, _ in rows], words, answers, vocab)

    def set_words(self) -> None:
        ids = [[self.vocab[w] for w in ws] for ws in self.words]
        self.telling = [np.unique(np.array(i, np.int64)) for i in ids]
        self.masks = [(_masks(i), _masks([self.vocab[w] for w in ws])) for i, ws in zip(ids, self.answers)]
        self.need = np.array([max(len(t) - (1 - MIN_LCS) * len(i), 1) for t, i in zip(self.telling, ids)])
        self.reach = max(map(len, ids))
        self.span = [len(i) + len(i) // 4 + 4 for i in ids]
        self.section = max(SECTION, -(-2 * self.reach // STRIDE))
        pairs = sorted((w, k) for k, t in enumerate(self.telling) for w in t.tolist())
        self.first = np.searchsorted([w for w, _ in pairs], np.arange(len(self.vocab) + 1))
        self.holders = np.array([k for _, k in pairs], np.int64)

    def fitting(self, known: np.ndarray, pos: np.ndarray):
        """(section, items) wherever enough of the items' distinct words stand near the section.

        A section is ``self.section`` strides; near is within the reach of its passages' checks.
        An item that is not given fails the text check at each place of the section.
        """
        v, k, size = len(self.vocab), len(self.ids), self.section * STRIDE
        over = LONG * STRIDE + self.reach
        for base in range(0, int(pos[-1]) // size + 1, SECTIONS):
            last = min(int(pos[-1]) // size, base + SECTIONS - 1)
            a, z = np.searchsorted(pos, (base * size - self.reach, (last + 1) * size + over))
            at, words = pos[a:z], known[a:z]
            g = np.minimum((at + self.reach) // size, last)
            keys = []
            while True:
                near = (g >= base) & (at < (g + 1) * size + over)
                if not near.any():
                    break
                keys.append((g[near] - base) * v + words[near])
                g = g - 1
            if not keys:
                continue
            here, w = np.divmod(np.unique(np.concatenate(keys)), v)
            held = self.first[w + 1] - self.first[w]
            ends = np.cumsum(held)
            which = self.holders[np.arange(ends[-1]) + np.repeat(self.first[w] - (ends - held), held)]
            n = np.bincount(np.repeat(here, held) * k + which, minlength=(last + 1 - base) * k).reshape(-1, k)
            fits = n >= self.need
            for i in np.flatnonzero(fits.any(1)).tolist():
                yield base + i, fits[i]

    def part_rows(self) -> list[tuple[int, list[bytes]]]:
        out = []
        for k, ws in enumerate(self.words):
            n = max(1, -(-len(ws) // LONG_PART))
            size = -(-len(ws) // n) if ws else 0
            out += [(k, ws[i : i + size]) for i in range(0, len(ws), size)] if ws else []
        return out


def _block_sums(ids: np.ndarray, pos: np.ndarray, table: np.ndarray, blocks: int) -> np.ndarray:
    """Sum of word vectors per stride; ``pos`` ascends."""
    out = np.zeros((blocks, table.shape[1]), table.dtype)
    if len(ids):
        b = pos // STRIDE
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        out[b[first]] = np.add.reduceat(table[ids], first, axis=0)
    return out


def _passages(sums: np.ndarray, strides: int) -> np.ndarray:
    """Overlapping passages of so many strides; a shorter text is one passage."""
    if len(sums) <= strides:
        return sums.sum(0, keepdims=True)
    out = sums[: len(sums) - strides + 1].copy()
    for i in range(1, strides):
        out += sums[i : len(sums) - strides + 1 + i]
    return out


def _encoded(docs: DataFrame, vocab: dict) -> tuple[DataFrame, np.dtype]:
    """(doc_id, words) of all documents: a text's words as numbers of the given type, -1 for those not in ``vocab``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    kind = np.dtype("<i2" if len(vocab) < 1 << 15 else "<i4")

    def run(batches):
        get = shared.value.get
        for b in batches:
            words = (words_of(text.as_py()) for text in b.column(1))
            coded = [np.fromiter(map(get, ws, repeat(-1)), kind, len(ws)).tobytes() for ws in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coded, pa.binary())], names=["doc_id", "words"])

    return common.written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words binary"), "lsi-words", 16 << 20), kind


def _batches_of(column, kind: np.dtype):
    """The texts' words, several texts at once."""
    texts: list[np.ndarray] = []
    many = 0
    for x in column:
        texts.append(np.frombuffer(x.as_buffer(), kind))
        many += len(texts[-1])
        if many >= WORDS:
            yield texts
            texts, many = [], 0
    if texts:
        yield texts


def document_frequencies(coded: DataFrame, size: int, kind: np.dtype) -> tuple[np.ndarray, int]:
    """Over all documents: in how many each of the ``size`` words is, and how many there are."""

    def run(batches):
        total, n = np.zeros(size, np.int64), 0
        at_once = max(1, (1 << 22) // size)
        for b in batches:
            for texts in _batches_of(b.column(0), kind):
                for i in range(0, len(texts), at_once):
                    some = texts[i : i + at_once]
                    # the last column is that of -1
                    held = np.zeros((len(some), size + 1), bool)
                    held[np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some)] = True
                    total += held[:, :size].sum(0)
                n += len(texts)
        w = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[w, -1], pa.int64()), pa.array(np.r_[total[w], n], pa.int64())], names=["w", "n"])

    got = coded.select("words").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(size), 0
    for w, c in got:
        if w < 0:
            n = c
        else:
            df[w] = c
    return df, n


def randomised_svd(passages, vocab_size: int, rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (vocab, rank). ``passages(table)`` maps a (vocab, k) table to
    the sum over all passage rows m of m^T (m table), added up over the tasks; two such
    products, the second on the first one's range, give it (Nystroem's form)."""
    r = np.random.default_rng(seed)
    k = min(rank + OVERSAMPLE, vocab_size)
    q = np.linalg.qr(passages(np.linalg.qr(r.standard_normal((vocab_size, k)))[0]))[0]
    y = passages(q)
    small = q.T @ y
    val, vec = np.linalg.eigh((small + small.T) / 2)
    good = val > val[-1] * 1e-6
    return np.linalg.svd(y @ (vec[:, good] / np.sqrt(val[good])), full_matrices=False)[0][:, : min(rank, k)]


def _spread(out: np.ndarray, line: np.ndarray, share: np.ndarray) -> None:
    """Adds to each word's row of ``out`` the ``share`` of every stride that it stands in, as often as it does."""
    at = np.flatnonzero(line < len(out))
    words, strides = line.ravel()[at], at // STRIDE
    often = np.flatnonzero(np.bincount(words, minlength=len(out)) >= OFTEN)
    slot = np.full(len(out), -1)
    slot[often] = np.arange(len(often))
    slot = slot[words]
    few = slot < 0
    times = np.bincount(slot[~few] * len(line) + strides[~few], minlength=len(often) * len(line)).reshape(len(often), len(line))
    out[often] += times.astype(share.dtype) @ share
    words, strides = words[few], strides[few]
    if len(words):
        order = np.argsort(words.astype(np.uint16) if len(out) < 1 << 16 else words, kind="stable")
        words = words[order]
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        out[words[first]] += np.add.reduceat(np.take(share, strides[order], axis=0), first, axis=0)


def _add_product(out: np.ndarray, texts: list[np.ndarray], table: np.ndarray) -> int:
    """Adds the sum over the texts' passages m of m^T (m table) to ``out`` and returns how many there
    are. ``table`` has a last row of zeros, for the words that are not known."""
    ids = np.concatenate(texts)
    lengths = np.array([len(x) for x in texts])
    starts = np.cumsum(lengths) - lengths
    at = np.flatnonzero(ids >= 0)
    lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + lengths)
    has = hi > lo
    if not has.any():
        return 0
    lo, hi, starts = lo[has], hi[has], starts[has]
    blocks = (at[hi - 1] - starts) // STRIDE + 1
    # texts stand in a line so far apart that no passage reaches the next one
    taken = blocks + LONG - 1
    first, size = np.cumsum(taken) - taken, int(taken.sum())
    line = np.full((size, STRIDE), len(table) - 1, np.int32)
    line.ravel()[at + np.repeat(first * STRIDE - starts, hi - lo)] = ids[at]
    many = np.maximum(blocks - LONG + 1, 1)
    turn = np.zeros(size + 1, np.int8)
    turn[first], turn[first + many] = 1, -1
    whole = np.cumsum(turn[:-1]) > 0  # a passage of a text starts here
    for a in range(0, size - LONG + 1, PIECE):
        piece = line[a : a + PIECE + LONG - 1]
        n = len(piece) - LONG + 1
        sums = np.take(table, piece[:, 0], axis=0)
        for j in range(1, STRIDE):
            sums += np.take(table, piece[:, j], axis=0)
        pas = _passages(sums, LONG)
        pas[~whole[a : a + n]] = 0
        # a stride takes part in the passages that start LONG - 1 strides before it or later
        share = np.zeros_like(sums)
        for i in range(LONG):
            share[i : i + n] += pas
        _spread(out, piece, share)
    return int(many.sum())


def _sum_products(coded: DataFrame, kind: np.dtype, idf: np.ndarray, own: list[np.ndarray]):
    """The ``passages`` of randomised_svd: those of all documents and the items themselves."""

    def passages(table: np.ndarray) -> np.ndarray:
        weighted = np.vstack([table * idf[:, None], np.zeros((1, table.shape[1]))]).astype(np.float32)
        sent = coded.sparkSession.sparkContext.broadcast(weighted)
        shape = table.shape

        def rows_of(got):
            cols = list(zip(*got)) if got else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int64()))], names=["at", "part", "n"])

        def run(batches):
            total, n = np.zeros(shape), 0
            for b in batches:
                for texts in _batches_of(b.column(0), kind):
                    n += _add_product(total, texts, sent.value)
            if n:
                yield rows_of([(i, total[i : i + ROWS].astype(np.float32).tobytes(), n if i == 0 else 0) for i in range(0, shape[0], ROWS)])

        def add(batches):
            total: dict[int, list] = {}
            for b in batches:
                for at, part, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                    held = total.setdefault(at, [0.0, 0])
                    held[0] = held[0] + np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
                    held[1] += n
            yield rows_of([(at, x.tobytes(), n) for at, (x, n) in total.items()])

        # one table reaches the driver: those of the tasks are added up by ranges of words
        schema = "at long, part binary, n long"
        parts = coded.select("words").mapInArrow(run, schema).repartition("at").mapInArrow(add, schema).collect()
        sent.destroy()
        out, n = np.zeros(shape), 0
        for at, part, some in parts:
            out[at : at + ROWS] = np.frombuffer(part).reshape(-1, shape[1])
            n += some
        mine = np.zeros(shape)
        rows = sum(_add_product(mine, [x], weighted) for x in own)
        # items and corpus passages weigh the same in total, or the items' words would be lost in the tail
        return (out / max(n, 1) + mine / max(rows, 1)) * idf[:, None]

    return passages


def _search(coded: DataFrame, kind: np.dtype, items: Items, min_cosine: float) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(items)

    def check(it: Items, k: int, at: np.ndarray, ids: list[int], a: int, b: int, start: int, end: int) -> tuple[float, float]:
        """Best (lcs share, answer share) of item k in a stretch of words ``start`` to ``end`` no longer
        than ``it.span``. The item's words ``a`` to ``b`` stand there, at places ``at``."""
        n, size = len(it.words[k]), max(len(it.answers[k]), 1)
        whole, answer = it.masks[k]
        best = (0.0, 0.0)
        step = max(4, n // 8)
        starts = np.arange(max(start, at[a] - step), at[b - 1] + 1, step)
        ends = np.searchsorted(at, np.minimum(starts + it.span[k], end))
        for i, j in zip(np.searchsorted(at, starts).tolist(), ends.tolist()):
            # the subsequence is no longer than the words there are
            if j - i < MIN_LCS * n or j - i <= best[0] * n:
                continue
            part = ids[i:j]
            got = _lcs(whole, n, part) / n
            if got > best[0]:
                best = (got, _lcs(answer, len(it.answers[k]), part) / size)
        return best

    def best_of(it: Items, k: int, at: np.ndarray, ids: list[int], cosines, strides) -> tuple[float, float, float] | None:
        """Best (cosine, lcs share, answer share) of item k, whose words are at ``at``, over places of falling cosine."""
        n = len(it.words[k])
        lo = np.searchsorted(at, strides * STRIDE - n)
        hi = np.searchsorted(at, (strides + LONG) * STRIDE + n)
        best, tried = None, set()
        enough = hi - lo >= max(it.need[k], MIN_LCS * n)
        for c, r, a, b in zip(*(x[enough].tolist() for x in (cosines, strides, lo, hi))):
            if r in tried:  # the check looks an item's length around
                continue
            tried.update(range(r - 2, r + 3))
            if len(set(ids[a:b])) < it.need[k]:
                continue
            got = check(it, k, at, ids, a, b, r * STRIDE - n, (r + LONG) * STRIDE + n)
            if best is None or got > best[1:]:
                best = (c, *got)
                if got[0] >= SURE_LCS:
                    break
        return best

    def search_section(it: Items, mark: np.ndarray, known: np.ndarray, pos: np.ndarray, section: int, fits: np.ndarray):
        """(item, its best place) for the fitting items near a passage that starts in the section."""
        first, blocks = section * it.section, it.section + LONG - 1
        a, z = np.searchsorted(pos, (first * STRIDE - it.reach, (first + blocks + 1) * STRIDE + it.reach))
        near, places = known[a:z], pos[a:z]
        hits: dict[int, tuple[np.ndarray, list[int]]] = {}
        for k in np.flatnonzero(fits).tolist():
            mark[it.telling[k]] = True
            own = mark[near]
            mark[it.telling[k]] = False
            at = places[own]
            # a stretch that passes has so many of the item's words
            least = max(int(np.ceil(MIN_LCS * len(it.words[k]) - 1e-9)), 1)
            if len(at) >= least and (at[least - 1 :] - at[: len(at) - least + 1]).min() < it.span[k]:
                hits[k] = at, near[own].tolist()
        if not hits:
            return
        a, z = np.searchsorted(pos, (first * STRIDE, (first + blocks) * STRIDE))
        sums = _block_sums(known[a:z], pos[a:z] - first * STRIDE, it.embed, blocks)
        chosen = np.isin(it.part_item, list(hits))
        for strides, of in ((SHORT, np.flatnonzero(chosen & ~it.part_long)), (LONG, np.flatnonzero(chosen & it.part_long))):
            if not len(of):
                continue
            passages = _passages(sums, strides)
            norm = np.maximum(np.linalg.norm(passages, axis=1), 1e-6)
            cos = passages @ it.parts[of].T / norm[:, None]
            for k in np.unique(it.part_item[of]).tolist():
                best = cos[:, it.part_item[of] == k].max(1)
                rows = np.flatnonzero(best >= min_cosine) if min_cosine > -1 else np.arange(len(best))
                rows = rows[np.lexsort((-rows, -best[rows]))]
                got = best_of(it, k, *hits[k], best[rows], rows + first)
                if got:
                    yield k, got

    def search(it: Items, mark: np.ndarray, texts: list[np.ndarray]):
        """(text, item, cosine, lcs share, answer share) of each pair, of several texts at once."""
        # a text starts at a section of its own, that no section with words of the text before reaches
        size = it.section * STRIDE
        taken = np.array([-(-len(ws) // size) for ws in texts])
        between = -(-(LONG * STRIDE + it.reach) // size)
        starts = np.cumsum(taken + between) - taken - between
        ids = np.concatenate(texts).astype(np.int64)
        lengths = np.array([len(ws) for ws in texts])
        ahead = np.cumsum(lengths) - lengths
        here = np.flatnonzero(ids >= 0)
        if not len(here):
            return
        pos = here + np.repeat(starts * size - ahead, lengths)[here]
        known = ids[here]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for section, fits in it.fitting(known, pos):
            text = int(np.searchsorted(starts, section, side="right")) - 1
            if section >= starts[text] + taken[text]:  # between two texts
                continue
            for k, got in search_section(it, mark, known, pos, section, fits):
                if (text, k) not in best or got[1:] > best[text, k][1:]:
                    best[text, k] = got
        for (text, k), got in best.items():
            if got[1] >= SURE_LCS or got[1] >= MIN_LCS and got[2] >= MIN_ANSWER:
                yield text, it.ids[k], *got

    def run(batches):
        it = shared.value
        mark = np.zeros(len(it.vocab), bool)
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[tuple[int, int, float, float, float]] = []
            done = 0
            for texts in _batches_of(b.column(1), kind):
                rows = [i for i, x in enumerate(texts, done) if len(x)]
                done += len(texts)
                if rows:
                    out += [(ids[rows[t]], *rest) for t, *rest in search(it, mark, [x for x in texts if len(x)])]
            cols = list(zip(*out)) if out else [(), (), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return coded.mapInArrow(run, "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")


def find_contamination(docs: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) of every contaminated pair.

    A pair counts if the item's words are in the document in order, by a share of
    SURE_LCS, or of MIN_LCS with MIN_ANSWER of its answer, within a stretch at most a
    quarter longer than the item. Null and empty texts and items give no pair; null
    doc ids pass through; repeated rows give repeated pairs; items with the same id
    give a pair each; other columns are ignored.

    Items are searched in blocks of at most BLOCK_ITEMS and BLOCK_BYTES, so the
    broadcast is bounded; for each block the documents' words are stored as numbers once,
    which serve the frequencies, the latent space (of all documents) and one narrow pass
    over all passages.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    bench = bench.where(F.octet_length("text") > 0)
    found: DataFrame | None = None
    for rows in _item_blocks(bench):
        items = Items.of(rows)
        if not items.vocab:
            continue
        coded, kind = _encoded(src, items.vocab)
        df, n = document_frequencies(coded, len(items.vocab), kind)
        # never 0: an item that most documents hold keeps its weight
        idf = np.log((n + 1) / (df + 1)) + 1
        parts = items.part_rows()
        own = [np.array([items.vocab[w] for w in ws]) for _, ws in parts]
        basis = randomised_svd(_sum_products(coded, kind, idf, own), len(items.vocab), RANK)
        items.embed = (basis * idf[:, None]).astype(np.float32)
        vec = np.array([items.embed[[items.vocab[w] for w in ws]].sum(0) for _, ws in parts])
        norm = np.linalg.norm(vec, axis=1, keepdims=True)
        items.parts = (vec / np.maximum(norm, 1e-6)).astype(np.float32)
        items.part_item = np.array([k for k, _ in parts])
        items.part_long = np.array([len(ws) > SHORT_PART for _, ws in parts])
        items.set_words()
        one = _search(coded, kind, items, min_cosine)
        found = one if found is None else found.union(one)
    if found is None:
        return src.where("false").select("doc_id", F.lit(None).cast("long").alias("item_id"), *(F.lit(None).cast("double").alias(c) for c in ("cosine", "lcs_share", "answer_share")))
    return found


def _item_blocks(bench: DataFrame):
    """Bounded lists of (item_id, text): streamed, one partition at a time on the driver."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in bench.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block
