"""Toxicity: bidirectional gated recurrent network with attention pooling, in numpy.

A window of words is read in both directions; a word's input joins its own embedding
(if the training sample has it) with the mean of its characters' trigram embeddings.
Attention pools the states of a window to one logit. A document's score is the
highest of all its overlapping windows, in training (max pooling over the bag) as in
scoring. The input half of the gates is computed once per distinct word.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Most labelled rows of a class the network is fitted on (least hashes), and their most bytes.
MAX_TRAIN, MAX_TRAIN_BYTES = 2000, 16_000
WINDOW, STRIDE = 48, 32
HIDDEN, ATTN, WORD_DIM, CHAR_DIM = 8, 8, 4, 4
TRIGRAMS = 4096
VOCAB = 20_000
CACHE = 150_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trigram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket per trigram, start of each word): byte trigrams of ``^word$``."""
    raw = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8).astype(np.uint32)
    code = ((flat[:-2] * np.uint32(65599) + flat[1:-1]) * np.uint32(65599) + flat[2:]) * np.uint32(2654435761)
    n = size - 2
    ends = np.cumsum(size)
    first = ends - size
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return (code[at] >> np.uint32(20)).astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]])


class Network:
    """Parameters are float32 arrays in ``p``; word row 0 is padding, row 1 any unknown word."""

    def __init__(self, vocab: dict[str, int], seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        g = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
        self.vocab = vocab
        self.p = {
            "word": g(len(vocab) + 2, WORD_DIM, k=0.05), "char": g(TRIGRAMS, CHAR_DIM, k=0.1),
            "wf": g(d, 3 * h), "wb": g(d, 3 * h), "uf": g(h, 3 * h), "ub": g(h, 3 * h), "bf": g(3 * h, k=0), "bb": g(3 * h, k=0),
            "wa": g(2 * h, ATTN), "ba": g(ATTN, k=0), "va": g(ATTN), "wo": g(2 * h), "bo": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def inputs(self, words: list[str]) -> np.ndarray:
        """(n, dims) inputs of distinct words."""
        if not words:
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        rows, start = trigram_rows(words)
        count = np.diff(np.append(start, len(rows)))[:, None]
        chars = np.add.reduceat(self.p["char"][rows], start) / count
        idx = np.fromiter((self.vocab.get(w, 1) for w in words), np.int64, len(words))
        return np.concatenate([self.p["word"][idx], chars], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]

    def forward(self, gate: tuple[np.ndarray, np.ndarray], idx: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; ``idx`` (windows, steps) are rows of ``gate``, mask is 1 on words."""
        b, t = idx.shape
        states = np.zeros((t, b, 2 * HIDDEN), np.float32)
        tape = []
        for side, u, steps in ((0, self.p["uf"], range(t)), (1, self.p["ub"], range(t - 1, -1, -1))):
            table = gate[side]
            h = np.zeros((b, HIDDEN), np.float32)
            for i in steps:
                x, y = table[idx[:, i]], h @ u
                zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])))
                z, rr = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + rr * y[:, 2 * HIDDEN :])
                if keep:
                    tape.append((side, i, h, z, rr, new, y[:, 2 * HIDDEN :]))
                h = new + z * (h - new)
                states[i, :, side * HIDDEN : (side + 1) * HIDDEN] = h
        a = np.tanh(states @ self.p["wa"] + self.p["ba"])
        e = np.where(mask.T > 0, a @ self.p["va"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbh->bh", w, states)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, (states, a, w, pooled, tape)) if keep else logit

    def backward(self, idx, mask, saved, d_logit, x) -> dict[str, np.ndarray]:
        """Gradients of all parameters but the embedding tables, and of the inputs (key x)."""
        states, a, w, pooled, tape = saved
        p, g = self.p, {}
        g["wo"], g["bo"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * p["wo"]
        d_states = w[:, :, None] * d_pooled[None]
        d_w = np.einsum("tbh,bh->tb", states, d_pooled)
        d_e = w * (d_w - (w * d_w).sum(0)) * (mask.T > 0)
        g["va"] = np.einsum("tba,tb->a", a, d_e)
        d_a = d_e[:, :, None] * p["va"] * (1 - a**2)
        g["wa"] = np.einsum("tbh,tba->ha", states, d_a)
        g["ba"] = d_a.sum((0, 1))
        d_states = d_states + d_a @ p["wa"].T
        d_gate = [np.zeros((len(x), 3 * HIDDEN), np.float32) for _ in range(2)]
        for name in ("uf", "ub"):
            g[name] = np.zeros_like(p[name])
        d_h, last = None, None
        for side, i, h, z, rr, new, yn in reversed(tape):
            u = p["ub"] if side else p["uf"]
            if side != last:
                d_h, last = np.zeros_like(h), side
            d = d_h + d_states[i, :, side * HIDDEN : (side + 1) * HIDDEN]
            d_new, d_z = d * (1 - z), d * (h - new)
            d_n = d_new * (1 - new**2)
            d_zr = np.concatenate([d_z * z * (1 - z), d_n * yn * rr * (1 - rr)], 1)
            d_y = np.concatenate([d_zr, d_n * rr], 1)
            g["ub" if side else "uf"] += h.T @ d_y
            d_h = d * z + d_y @ u.T
            np.add.at(d_gate[side], idx[:, i], np.concatenate([d_zr, d_n], 1))
        f, b = d_gate
        g["wf"], g["wb"], g["bf"], g["bb"] = x.T @ f, x.T @ b, f.sum(0), b.sum(0)
        g["x"] = f @ p["wf"].T + b @ p["wb"].T
        return g


def windows_of(n: int) -> list[tuple[int, int]]:
    """[start, end) of all windows over n words: every word is in one, neighbours overlap."""
    out, start = [], 0
    while True:
        out.append((start, min(start + WINDOW, n)))
        if start + WINDOW >= n:
            return out
        start += STRIDE


def _window_rows(ids: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    spans = windows_of(len(ids))
    start = np.array([s for s, _ in spans])[:, None] + np.arange(WINDOW)[None, :]
    mask = start < len(ids)
    return np.where(mask, ids[np.minimum(start, len(ids) - 1)], pad), mask.astype(np.float32)


def train_network(texts: list[str], labels: list[int], epochs: int = 4, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit on whole texts; a text's loss is that of its highest window."""
    # words are held as numbers: the sample's texts as lists of strings would weigh on the task
    number: dict[str, int] = {}
    tokens = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int32) for t in texts]
    names = list(number)
    del number
    y = np.array(labels, np.float32)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    df1, df0 = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for ws, lab in zip(tokens, labels):
        (df1 if lab else df0)[np.unique(ws)] += 1
    total = df1 + df0
    often = np.argsort(-total, kind="stable")[:VOCAB]
    chosen = sorted((names[i], int(i)) for i in often if total[i] >= 4)
    vocab = {w: i for i, (w, _) in enumerate(chosen, 2)}
    net = Network(vocab, seed)
    if not n1 or not n0:
        net.constant = n1 / max(len(y), 1)
        return net
    # the first dimension starts as the smoothed log-odds of documents that hold the word
    for i, (_, k) in enumerate(chosen, 2):
        odds = math.log((df1[k] + 1) / (n1 + 2)) - math.log((df0[k] + 1) / (n0 + 2))
        net.p["word"][i, 0] = np.clip(odds, -4, 4) / 4 * min(1.0, total[k] / 12)
    net.p["word"][0] = 0
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    r, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = r.permutation(len(tokens))
        for lo in range(0, len(order), batch):
            docs = [i for i in order[lo : lo + batch] if len(tokens[i])]
            if not docs:
                continue
            used = np.unique(np.concatenate([tokens[i] for i in docs]))
            distinct = [names[k] for k in used]
            x = np.concatenate([net.inputs(distinct), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])
            pad = len(distinct)
            got = [_window_rows(np.searchsorted(used, tokens[i]), pad) for i in docs]
            idx, mask = np.concatenate([a for a, _ in got]), np.concatenate([m for _, m in got])
            size = [len(a) for a, _ in got]
            gate = net.gates(x)
            logit = net.forward(gate, idx, mask)
            ends = np.cumsum(size)
            best = np.array([e - s + int(np.argmax(logit[e - s : e])) for s, e in zip(size, ends)])
            logit, saved = net.forward(gate, idx[best], mask[best], keep=True)
            # classes weigh as if equally frequent
            weight = np.where(y[docs] > 0, 0.5 * len(y) / n1, 0.5 * len(y) / n0)
            d_logit = ((_sigmoid(logit) - y[docs]) * weight / len(docs)).astype(np.float32)
            g = net.backward(idx[best], mask[best], saved, d_logit, x)
            gx = g.pop("x")[:-1]
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], [net.vocab.get(w, 1) for w in distinct], gx[:, :WORD_DIM])
            rows, start = trigram_rows(distinct)
            count = np.diff(np.append(start, len(rows)))
            np.add.at(g["char"], rows, np.repeat(gx[:, WORD_DIM:] / count[:, None], count, 0))
            step += 1
            for k, grad in g.items():
                m, v = moment[k]
                grad = np.clip(grad, -1, 1)
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            net.p["word"][0] = 0
    return net


class Scorer:
    """Scores texts with a network; remembers the gate inputs of up to CACHE words."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        pad = self.net.gates(np.zeros((1, WORD_DIM + CHAR_DIM), np.float32))
        self.table = tuple(np.concatenate([g, np.zeros((4095, 3 * HIDDEN), np.float32)]) for g in pad)

    def _learn(self, new: list[str]) -> None:
        rows = self.net.gates(self.net.inputs(new))
        at = len(self.index)
        while at + len(new) > len(self.table[0]):
            self.table = tuple(np.concatenate([t, np.zeros_like(t)]) for t in self.table)
        for t, r in zip(self.table, rows):
            t[at : at + len(new)] = r
        self.index.update(zip(new, range(at, at + len(new))))

    def score(self, texts: list[str | None]) -> list[float]:
        if self.net.constant is not None:
            return [self.net.constant] * len(texts)
        out = np.zeros(len(texts))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for i, t in enumerate(texts):
            ws = words_of(t)
            if not ws:
                continue
            if len(self.index) > CACHE:
                self._flush(held, out)
                n = 0
                self.reset()
            get = self.index.get
            ids = [get(w) for w in ws]
            if None in ids:
                self._learn(list(dict.fromkeys(w for w, k in zip(ws, ids) if k is None)))
                get = self.index.get
                ids = [get(w) for w in ws]
            idx, mask = _window_rows(np.array(ids, np.int64), 0)
            held.append((np.full(len(idx), i), idx, mask))
            n += len(idx)
            if n >= 1024:
                self._flush(held, out)
                n = 0
        self._flush(held, out)
        return out.tolist()

    def _flush(self, held: list, out: np.ndarray) -> None:
        if not held:
            return
        doc, idx, mask = (np.concatenate([h[k] for h in held]) for k in range(3))
        for lo in range(0, len(idx), 1024):
            s = slice(lo, lo + 1024)
            np.maximum.at(out, doc[s], _sigmoid(self.net.forward(self.table, idx[s], mask[s])))
        held.clear()


_SCORERS: dict[str, Scorer] = {}


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", most: int = MAX_TRAIN, most_bytes: int = MAX_TRAIN_BYTES) -> DataFrame | None:
    """At most ``most`` (text, y) rows of each class, those with the least id hashes, in one partition; None if there are none."""
    lab = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    src = docs.where(train).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.where(F.octet_length("text") <= most_bytes)
    # the ids are chosen first, so that only their texts move
    rows = src.select("doc_id").join(lab, "doc_id")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked: dict[int, list[int]] = {0: [], 1: []}
    for k in (0, 1):
        if sizes.get(k):
            picked[k] = [r[0] for r in common.hash_sample(rows.where(F.col("y") == k).select("doc_id"), ["doc_id"], most, sizes[k]).collect()]
    if not picked[0] + picked[1]:
        return None
    got = src.where(F.col("doc_id").isin(picked[0] + picked[1])).withColumn("y", F.col("doc_id").isin(picked[1]).cast("int"))
    return got.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * most).select("text", "y")


def fit_network(sample: DataFrame | None) -> Network:
    """Fit in one task, so that the sample's texts never reach the driver; only the network does."""
    if sample is None:
        return train_network([], [])

    def run(batches):
        texts: list[str] = []
        labels: list[int] = []
        for b in batches:
            texts += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train_network(texts, labels))], pa.binary())], names=["net"])

    got = sample.mapInArrow(run, "net binary").collect()
    return pickle.loads(bytes(got[0]["net"])) if got else train_network([], [])


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", max_train: int = MAX_TRAIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted (and the ``keep`` columns) for every row of ``docs``.

    Null, empty and wordless texts score 0. If the labelled rows hold one class only
    (or none), every row scores the share of label 1. Repeated rows and null ids are
    scored one by one. A document's label is the highest given. Scoring is narrow; the
    broadcast network has a fixed bound (VOCAB words, TRIGRAMS buckets).
    """
    net = fit_network(labelled_sample(docs, labels, train, label, max_train))
    shared, key = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex
    extra = [c for c in keep if c not in ("doc_id", "score", "predicted", "text")]

    def run(batches):
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        scorer = _SCORERS[key]
        for b in batches:
            texts = b.column(1).to_pylist()
            got = np.array(scorer.score(texts), np.float64)
            cols = [b.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32)), b.column(1), *(b.column(2 + i) for i in range(len(extra)))]
            cols = cols if "text" in keep else cols[:3] + cols[4:]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    names = ["doc_id", "score", "predicted", *(["text"] if "text" in keep else []), *extra]
    kinds = {"score": "double", "predicted": "int"} | types
    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))
