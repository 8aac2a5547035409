"""URL filter: host/path rules, then a character language-model ratio.

Two smoothed variable-order Markov models over the characters of a URL, one for
accepted and one for rejected URLs, are interpolated Witten-Bell style from the
longest seen context down to the uniform distribution. A URL's score is the
difference of its log-likelihoods divided by its length; the threshold is the one
with the best balanced accuracy on the tenth of the training URLs held back.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ALPHABET = 256
#: Most labelled URLs of a class the models are fitted on (the least hashes of all).
MAX_TRAIN = 4000
ORDER = 5


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, text: str) -> "Rule":
        verdict, _, rest = text.strip().partition(" ")
        if verdict not in ("allow", "block") or "/" not in rest:
            raise ValueError(f"no rule: {text!r}")
        host, _, path = rest.strip().partition("/")
        return cls(verdict, host.lower(), "/" + path)

    @property
    def text(self) -> str:
        return self.host + self.path


class MarkovModel:
    """Variable-order character model: p(c | context) backs off through all shorter contexts."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        self.stats: dict[bytes, tuple[int, int]] = {}

    def fit(self, urls: list[bytes]) -> "MarkovModel":
        for u in urls:
            s = b"\x02" + u + b"\x03"
            for i in range(1, len(s)):
                for k in range(min(self.order, i) + 1):
                    self.counts[s[i - k : i]][s[i]] += 1
        self.counts = {k: dict(v) for k, v in self.counts.items()}
        self.stats = {k: (sum(v.values()), len(v)) for k, v in self.counts.items()}
        return self

    def log_likelihood(self, url: bytes) -> float:
        s, total = b"\x02" + url + b"\x03", 0.0
        counts, stats = self.counts, self.stats
        for i in range(1, len(s)):
            c, p = s[i], 1.0 / ALPHABET
            for k in range(min(self.order, i) + 1):
                ctx = s[i - k : i]
                got = stats.get(ctx)
                if got is None:
                    break
                n, kinds = got
                p = (counts[ctx].get(c, 0) + kinds * p) / (n + kinds)
            total += math.log(p)
        return total


@dataclass
class RatioFilter:
    accepted: MarkovModel
    rejected: MarkovModel
    threshold: float

    def score(self, url: str | None) -> float:
        raw = (url or "").encode("utf-8", "surrogatepass")
        return (self.accepted.log_likelihood(raw) - self.rejected.log_likelihood(raw)) / (len(raw) + 1)

    def allows(self, url: str | None) -> bool:
        return self.score(url) >= self.threshold


def fit_filter(accepted: list[str], rejected: list[str], order: int = ORDER) -> RatioFilter | None:
    """None where either class is empty: nothing can be told apart."""
    if not accepted or not rejected:
        return None
    enc = lambda xs: [x.encode("utf-8", "surrogatepass") for x in xs]
    good, bad = enc(sorted(accepted)), enc(sorted(rejected))
    hold = lambda xs: (xs[::10], [x for i, x in enumerate(xs) if i % 10]) if len(xs) >= 20 else (xs, xs)
    (good_v, good_t), (bad_v, bad_t) = hold(good), hold(bad)
    f = RatioFilter(MarkovModel(order).fit(good_t), MarkovModel(order).fit(bad_t), 0.0)
    scored = sorted([(f.score(u.decode("utf-8", "surrogatepass")), 1) for u in good_v] + [(f.score(u.decode("utf-8", "surrogatepass")), 0) for u in bad_v])
    best, under_good, under_bad = (-1.0, 0.0), 0, 0
    for i, (s, kind) in enumerate(scored):
        acc = ((len(good_v) - under_good) / len(good_v) + under_bad / len(bad_v)) / 2
        low = scored[i - 1][0] if i else s - 1e-6
        if acc > best[0]:
            best = (acc, (low + s) / 2)
        under_good, under_bad = under_good + kind, under_bad + 1 - kind
    f.threshold = best[1]
    return f


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.lit(2**31 - 1))
    path = F.regexp_extract(after, r"(?s)^([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def match_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules: list[str], order: int = ORDER, max_train: int = MAX_TRAIN) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages``.

    URLs that a rule settles are the labelled rows: allowed ones are accepted examples,
    blocked ones rejected. The models are fitted on at most ``max_train`` distinct
    URLs of a class, those with the least hash, so on a bounded sample of all rows.
    A URL without a rule is allowed iff its ratio reaches the threshold; if either
    class has no example it is allowed. Null and empty URLs score as the empty string
    and so get a verdict too. Repeated rows and ids are judged one by one; other
    columns are ignored. Plan: narrow but for two bounded top-n passes.
    """
    spark = pages.sparkSession
    parsed = [Rule.parse(r) for r in rules]
    url = F.col("url").cast("string")
    host, path = host_path(url)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), parsed)
    base = base.withColumns({"rule": rule, "said": verdict})

    def sample(kind: str) -> list[str]:
        rows = base.where(F.col("said") == kind).select("url").distinct()
        return [r[0] for r in common.hash_sample(rows, ["url"], max_train).collect()]

    model = spark.sparkContext.broadcast(fit_filter(sample("allow"), sample("block"), order))

    def run(batches):
        f = model.value
        for b in batches:
            urls, said = b.column(1).to_pylist(), b.column(5).to_pylist()
            scores = [None if v or f is None else f.score(u) for u, v in zip(urls, said)]
            out = [v or ("allow" if s is None or s >= f.threshold else "block") for v, s in zip(said, scores)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), b.column(4), pa.array(out, pa.string()), pa.array(scores, pa.float64())],
                names=["page_id", "host", "path", "rule", "verdict", "score"],
            )

    return base.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
