"""Stages of corpus_pipeline against brute-force versions, and odd tables through all of them."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sluice.llm import substring_dedup, toxicity

ITEM = "the quick purple walrus measured seventeen copper kettles. then it sang about distant rivers"
#: uid, keep, score and n clash with names that the operators use
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, keep boolean, score string, n long"


def _row(i, text):
    return (i, text, "en", "s", len(text) if text else 0, 7, False, "z", None)


def _prose(seed, n=130):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, 2000, n)]


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(_prose(i)) + (" awful scumbag" if i % 4 == 0 else "")) for i in range(80)]
    for j in range(3):  # a chain of near copies of document 1
        ws = _prose(1)
        for k in (10, 60, 110)[: j + 1]:
            ws[k] = "changed"
        out.append((200 + j, " ".join(ws)))
    out += [(210, out[2][1]), (5, out[5][1]), (220, None), (221, ""), (222, "one two"), (223, "one two"), (None, "a lone text without an id")]
    shared = " ".join(_prose(999, 110))
    out += [(300 + j, f"{' '.join(_prose(700 + j, 200))} {shared} {' '.join(_prose(800 + j, 200))}") for j in range(3)]
    out += [(400, " ".join(_prose(401)) + " " + ITEM + " " + " ".join(_prose(402)))]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([_row(*r) for r in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def _classes(rows):
    """Rows that stay when each class of linked texts keeps its first row by id."""
    sets = []
    for _, t in rows:
        ws = t.lower().split() if t else []
        sets.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        if k not in best or (d is None, d) < (rows[best[k]][0] is None, rows[best[k]][0]):
            best[k] = i
    return Counter(rows[i] for i in best.values())


def _cut(rows, length=50):
    spots = [[m.span() for m in re.finditer(rb"[^\t-\r ]+", (t or "").encode())] for _, t in rows]
    words = [[(t or "").encode()[a:b] for a, b in at] for (_, t), at in zip(rows, spots)]
    seen = Counter(tuple(w[p : p + length]) for w in words for p in range(len(w) - length + 1))
    out = Counter()
    for (d, text), w, at in zip(rows, words, spots):
        runs = substring_dedup.merged((p, p + length) for p in range(len(w) - length + 1) if seen[tuple(w[p : p + length])] > 1)
        left = substring_dedup.cut((text or "").encode(), [(at[a][0], at[b - 1][1]) for a, b in runs]).decode()
        if not runs or left.strip():
            out[(d, left if runs else text)] += 1
    return out


def test_toxic_documents_go(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    out = cp.drop_toxic(spark, docs, sf_dir)
    assert out.columns == docs.columns
    train = F.expr("pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 5) <> 0")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    said = toxicity.score_toxicity(docs.select("doc_id", "text"), labels, train, keep=("text",)).where("predicted = 0")
    got = _pairs(out)
    assert got == _pairs(said)
    assert got[(220, None)] == got[(221, "")] == 1  # nothing in them to reject
    assert out.where("uid = 7 and score = 'z' and keep = false and n is null").count() == sum(got.values())


def test_near_copies_equal_brute_force(spark, sf_dir, rows):
    docs = _docs(spark, sf_dir)
    out = cp.drop_near_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert _pairs(out) == _classes(rows)


def test_repeats_equal_brute_force(spark, sf_dir, rows):
    docs = _docs(spark, sf_dir)
    out = cp.cut_repeats(spark, docs, sf_dir)
    assert out.schema == docs.schema
    assert _pairs(out) == _cut(rows)
    assert out.where("doc_id >= 300 and n_chars <> length(text)").count() == 0


def test_short_worded_passages_go(spark, sf_dir):
    """Passages of 51 to 70 short words, once in each of two to five documents; 49 words stay."""
    r = np.random.default_rng(11)
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, int(r.integers(2, 6))))
    out, marks = [], {}
    for g in range(30):
        n = 49 if g >= 26 else int(r.integers(51, 71))
        passage = " ".join(word() for _ in range(n))
        for j in range(2 + g % 4):
            pre, post = (" ".join(word() for _ in range(int(r.integers(0, 120)))) for _ in range(2))
            out.append((g * 10 + j, f"{pre}\n{passage}  {post}"))
            marks[g * 10 + j] = passage
    out += [(1000 + i, " ".join(word() for _ in range(100))) for i in range(40)]
    got = cp.cut_repeats(spark, spark.createDataFrame([_row(*x) for x in out], SCHEMA), sf_dir)
    assert _pairs(got) == _cut(out)
    texts = {d: t for d, t in _pairs(got)}
    assert all((marks[d] in texts[d]) == (d >= 260) for d in marks if d in texts)
    assert all(texts[d] == t for d, t in out if d >= 260)


def test_contaminated_documents_go(spark, sf_dir, rows):
    docs = _docs(spark, sf_dir)
    out = cp.drop_contaminated(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert _pairs(out) == Counter(r for r in rows if r[0] != 400)


def test_run_chains_the_stages(spark, sf_dir, rows):
    out = cp.run(spark, sf_dir)
    assert out.where("rate <= 0 or rate is null").count() == 0
    ids = {r[0] for r in out.select("doc_id").collect()}
    assert ids and ids <= {r[0] for r in rows}
    assert not ids & {200, 201, 202, 210, 223, 400}


def test_empty_tables(spark, sf_dir):
    none = _docs(spark, sf_dir).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_contamination_is_judged_without_a_sample(spark, tmp_path, monkeypatch):
    from sluice.llm import common

    def refuse(*_):
        raise AssertionError("a sample was taken")

    monkeypatch.setattr(common, "hash_sample", refuse)
    item = "the quick purple walrus measured seventeen copper kettles. then it sang about distant rivers"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = " ".join(f"w{i}" for i in range(4000))  # more bytes than the sample took
    docs = spark.createDataFrame([(1, plain), (2, f"{plain} {item}"), (None, None)], "doc_id long, text string")
    kept = cp.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in kept} == {1, None}
