"""Soft-membership mixing of documents to target token shares, in DataFrame functions only.

A linear discriminant over surface features of the text, fitted on the labelled
table, gives each document a posterior over the labels' domains. Non-negative rates
r are then fitted by projected gradient so that the expected domain totals
sum_d r_d n_d p_d(k) match the targets in least squares, starting from rate 1.

With a_d(k) = n_d p_d(k) and G = sum_d a_d a_d^T the squares are weighted by G^-1;
the gradient's Lipschitz constant is then 1, so the step is 1 and no line search is
needed. Only domain-by-domain sums and residuals ever reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: iterations between two stored states of the rates; most iterations; relative residual that ends them.
STORE_EVERY, MAX_ROUNDS, TOLERANCE = 8, 40, 1e-6
MAX_DOMAINS = 64
FEATURES = ("symbols", "digits", "upper", "marks", "lines", "word_length", "letters", "size", "bang")


#: the characters that a feature counts, by feature
COUNTED = {"symbols": "*#&$%@{}<>|=~^", "digits": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "marks": ".,;:?\"'()-", "bang": "!", "lines": "\n"}
#: all others; single characters, as a class of ranges takes some ten times as long
_OTHERS = "[^" + "".join(c if c.isalnum() or c == "\n" else "\\" + c for c in "".join(COUNTED.values())) + "]+"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, uid, n_tokens, n_chars_, shares of characters by kind and number of spaces; 0 for empty texts.

    A text is read twice: ``signs`` keeps the counted characters only, ``shape`` has one
    letter for each word, so that the counts are of short texts.
    """
    t = F.coalesce("text", F.lit(""))
    short = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("uid"), F.length(t).alias("n_chars_"),
        F.regexp_replace(t, _OTHERS, "").alias("signs"), F.regexp_replace(t, r"[^ \t\n\r\f\x0b]+", "a").alias("shape"),
    )
    n = F.col("n_chars_")
    among = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    share = {c: F.when(n > 0, among("signs", chars) / n).otherwise(F.lit(0.0)) for c, chars in COUNTED.items()}
    return short.select(
        "doc_id", "uid", among("shape", "a").cast("long").alias("n_tokens"), "n_chars_",
        F.least(share["symbols"] * 10, F.lit(1.0)).alias("symbols"), (share["digits"] * 10).alias("digits"), share["upper"].alias("upper"),
        (share["marks"] * 10).alias("marks"), F.least(share["bang"] * 10, F.lit(1.0)).alias("bang"), (share["lines"] * 10).alias("lines"),
        among("shape", " ").alias("spaces"),
    )


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, uid, n_tokens and the feature columns: the one pass over the texts."""
    base = features(docs)
    size = F.log1p(F.col("n_chars_").cast("double")) / 10
    word = F.when(F.col("n_tokens") > 0, F.col("n_chars_") / F.col("n_tokens") / 10).otherwise(0.0)
    letters = F.when(F.col("n_chars_") > 0, F.col("spaces") / F.col("n_chars_")).otherwise(0.0)
    return base.select(
        "doc_id", "uid", "n_tokens", *(F.col(c).cast("double").alias(c) for c in ("symbols", "digits", "upper", "marks", "bang", "lines")),
        size.alias("size"), F.least(word, F.lit(2.0)).alias("word_length"), letters.alias("letters"),
    )


def fit_discriminant(rows: DataFrame, label: str = "domain") -> tuple[list, np.ndarray, np.ndarray]:
    """(domains, weights, offsets) of the pooled-covariance discriminant, from one aggregate."""
    d = len(FEATURES)
    aggs = [F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in FEATURES)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"q_{i}_{j}") for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i <= j]
    got = rows.groupBy(label).agg(*aggs).orderBy(label).limit(MAX_DOMAINS + 1).collect()
    if len(got) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    if not got:
        return [], np.zeros((0, d)), np.zeros(0)
    total = sum(r["n"] for r in got)
    cov, means = np.zeros((d, d)), []
    for r in got:
        m = np.array([r[f"s_{c}"] for c in FEATURES]) / r["n"]
        q = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                q[i, j] = q[j, i] = r[f"q_{i}_{j}"]
        cov += q - r["n"] * np.outer(m, m)
        means.append(m)
    cov = cov / max(total - len(got), 1) + 1e-4 * np.eye(d)
    inv = np.linalg.inv(cov)
    means = np.array(means)
    prior = np.log(np.array([r["n"] for r in got]) / total)
    return [r[label] for r in got], means @ inv, prior - 0.5 * np.einsum("kd,de,ke->k", means, inv, means)


def posteriors(weights: np.ndarray, offsets: np.ndarray) -> list[Column]:
    """Softmax columns p(k) over the feature columns."""
    logit = [sum((F.col(c) * float(w) for c, w in zip(FEATURES, row)), F.lit(float(b))) for row, b in zip(weights, offsets)]
    top = F.greatest(*logit) if len(logit) > 1 else logit[0]
    e = [F.exp(x - top) for x in logit]
    return [x / sum(e[1:], e[0]) for x in e]


def fit_rates(table: DataFrame, targets: np.ndarray, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Add column rate to ``table`` (n_tokens, p0..pK-1); also returns the totals reached."""
    k = len(targets)
    a = [F.col("n_tokens") * F.col(f"p{i}") for i in range(k)]
    first = table.agg(*(F.sum(a[i] * a[j]) for i in range(k) for j in range(i, k)), *(F.sum(x) for x in a)).first()
    gram, it = np.zeros((k, k)), iter(first)
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = next(it) or 0.0
    reached = np.array([x or 0.0 for x in it])
    scale = max(np.trace(gram) / k, 1e-12)
    metric = np.linalg.pinv(gram + 1e-9 * scale * np.eye(k))
    state = table.withColumn("rate", F.lit(1.0))
    rate, since = F.col("rate"), 0
    for _ in range(max_rounds):
        if np.abs(reached - targets).sum() <= TOLERANCE * max(targets.sum(), 1.0):
            break
        move = metric @ (reached - targets)
        gradient = sum((x * float(m) for x, m in zip(a[1:], move[1:])), a[0] * float(move[0]))
        rate = F.greatest(F.lit(0.0), rate - gradient)
        since += 1
        if since == STORE_EVERY:
            state, rate, since = common.written(state.withColumn("rate", rate), "mix"), F.col("rate"), 0
        before = reached
        reached = np.array([x or 0.0 for x in state.agg(*(F.sum(rate * x) for x in a)).first()])
        if np.abs(reached - before).sum() <= 1e-9 * max(targets.sum(), 1.0):
            break
    return state.withColumn("rate", rate), reached


def mix(docs: DataFrame, labels: DataFrame, weights: dict, label: str = "quality", budget: float | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>..., rate for every row of ``docs``.

    ``weights`` maps each domain (a value of ``labels.<label>``) to its target share of
    the ``budget`` of tokens (default: the tokens there are). Shares are normalised; a
    domain without a weight has target 0, one that no labelled row has is ignored.
    Null and empty texts have 0 tokens and keep rate 1. Labels that are null or of
    null ids are left out; a document with several labels counts with the least one.
    Without any labelled row there is nothing to fit: every posterior set is empty
    and every rate is 1. Repeated rows are fitted one by one.
    Other columns of ``docs`` are ignored.

    Plan: one native pass over the texts writes a narrow table; every iteration is a
    sum over that table, and the labels meet it in one join on unique ids.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = common.written(_measured(src), "mix-features")
    lab = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("domain"))
    domains, w, b = fit_discriminant(table.join(lab, "doc_id"))
    if not domains:
        return table.select("doc_id", "n_tokens", F.lit(1.0).alias("rate"))
    cols = posteriors(w, b)
    table = common.written(table.select("doc_id", "uid", "n_tokens", *(c.alias(f"p{i}") for i, c in enumerate(cols))), "mix-posteriors")
    total = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    share = np.array([max(float(weights.get(d, 0.0)), 0.0) for d in domains])
    share = share / share.sum() if share.sum() > 0 else np.ones(len(domains)) / len(domains)
    out, _ = fit_rates(table, share * (total if budget is None else budget))
    return out.select("doc_id", "n_tokens", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)), "rate")
