"""Operators against brute force, round trips and edge cases."""

import hashlib
import io
import re
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import common, queries, decontaminate, lm_scoring, mixing, near_duplicates, substring_dedup, token_counts, topk_search, toxicity, url_filter, warc

EDGE = [(1, ""), (2, None), (3, "one"), (3, "one"), (None, "a b c d e f g h"), (5, "w " * 3000), (6, "a b c d e f g h")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "x") for r in EDGE], "doc_id long, text string, score string")


def test_warc_round_trip_and_validation(spark):
    rec = warc.build_record(7, "http://a/\n", b"body", warc.payload_digest(b"body"), None, "2024-01-01T00:00:00Z")
    out = io.BytesIO()
    w = warc.ArchiveWriter(out)
    for _ in range(3):
        w.add(rec)
    w.close()
    assert list(warc.read_frames(io.BytesIO(out.getvalue()))) == [rec] * 3
    assert warc.parse_record(rec).payload == b"body"
    for bad in (rec[:-1], rec.replace(b"body", b"bodx"), rec.replace(b"WARC-Date", b"X-Date"), b"junk"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(io.BytesIO(out.getvalue()[:-5])))
    pages = spark.createDataFrame([(1, "u", "same"), (9, None, "same"), (4, "v", None), (5, "v", ""), (6, "é", "x" * 100_000)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_pages(pages).collect()}
    assert (got[1]["record_type"], got[1]["refers_to"], got[9]["record_type"]) == ("revisit", 9, "response")
    assert (got[4]["refers_to"], got[5]["record_type"], got[6]["payload_bytes"]) == (5, "response", 100_000)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_reader_takes_plain_archives_and_repeated_headers():
    rec = warc.build_record(7, "http://a/", b"body", warc.payload_digest(b"body"), None, "2024-01-01T00:00:00Z")
    cookies = b"Set-Cookie: a=1\r\nSet-Cookie: b=2\r\n"
    size = int(warc.parse_record(rec).headers["content-length"])
    more = rec.replace(b"Content-Type: text/html", cookies + b"Content-Type: text/html").replace(b"Content-Length: %d\r" % size, b"Content-Length: %d\r" % (size + len(cookies)))
    assert warc.parse_record(more).http_headers["set-cookie"] == "a=1\nb=2"
    with pytest.raises(warc.WarcError):
        warc.parse_record(rec.replace(b"WARC-Date", b"WARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Date"))
    plain = b"".join(warc.zstd.ZstdCompressor().compress(r) for r in (rec, more))

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 3))

    for source in (io.BytesIO, Slow):
        assert list(warc.read_frames(source(plain))) == [rec, more]
    for bad in (b"", b"\x28\xb5", b"no archive at all"):
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(io.BytesIO(bad)))


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(1)
    vecs = r.standard_normal((400, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(500, None), (501, [float("nan")] * 16), (502, [float(x) for x in vecs[3]])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    q = np.floor(64 * np.concatenate([vecs, vecs[3:4]]))
    ids = [*range(400), 502]
    for i in range(0, 400, 20):
        want = sorted(((-int(q[i] @ q[j]), ids[j]) for j in range(len(ids)) if ids[j] != i))[:5]
        assert [(-g["score"], g["vec_id"]) for g in sorted((g for g in got if g["query_id"] == i), key=lambda g: g["rank"])] == want


def test_url_rules_and_model(spark):
    rules = ["allow org/", "block example.org/es/", "allow com/fr/", "block com/de/"]
    urls = [f"http://x{i}.com/fr/{i}" for i in range(60)] + [f"http://y{i}.com/de/bad{i}" for i in range(60)] + ["http://A.Example.ORG/es/1?q", "nothing", None, "x://n.net/fr/5"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, rules).collect()}
    assert (got[120]["host"], got[120]["path"], got[120]["rule"], got[120]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[121]["host"], got[121]["path"], got[122]["rule"]) == ("", "", None)
    assert got[123]["verdict"] == "allow" and got[0]["rule"] == "com/fr/"


def test_lm_base_and_normalisation(spark, edge):
    train = F.coalesce(F.col("doc_id") != 3, F.lit(True))
    got = lm_scoring.score_documents(edge, train).collect()
    assert len(got) == len(EDGE)
    counts = Counter(t for d, x in EDGE if d != 3 for t in [*lm_scoring.tokens(x), b""])
    n, v = sum(counts.values()), len(counts)
    for d, x in EDGE:
        toks = [*lm_scoring.tokens(x), b""]
        want = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in toks)
        assert any(r["doc_id"] == d and r["n_tokens"] == len(toks) and abs(r["base_score"] - want) < 1e-6 and r["train_tokens"] == n for r in got)
    a = lm_scoring.Automaton([5, 3, 2], 10, 3, [{(0, 1): 3, (1, 2): 2}], 0.5)
    for h in ((0,), (1,)):
        s = a.traverse([*h])[0]
        total = sum(10 ** (a.traverse([*h, w])[0] - s) for w in range(3)) + 10 ** (a.fail_log[a.start[h[0]]]) / 14
        assert abs(total - 1) < 1e-9


@pytest.mark.parametrize("cached", [0, 20, 1000])
def test_lm_keeps_every_repeated_ngram(spark, cached, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 500)
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in np.minimum(r.zipf(1.4, 40), 60)) for _ in range(60)] + ["", None]
    rows, train = list(enumerate(texts)), lambda i: i % 5 > 0
    toks = [[*lm_scoring.tokens(x), b""] for x in texts]
    index = {w: i for i, w in enumerate(sorted({w for ts in toks for w in ts}))}
    ids = [[index[w] for w in ts] for ts in toks]
    count = lambda n: Counter(tuple(x[p : p + n]) for i, x in enumerate(ids) if train(i) for p in range(len(x) - n + 1))
    uni = count(1)
    auto = lm_scoring.Automaton([uni[(i,)] for i in range(len(index))], sum(uni.values()), len(uni), [{g: c for g, c in count(n).items() if c >= 2} for n in (2, 3)], 0.5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in lm_scoring.score_documents(df, F.col("doc_id") % 5 > 0, cached=cached).collect()}
    for i, x in enumerate(ids):
        assert (got[i]["score"], got[i]["base_score"]) == pytest.approx(auto.traverse(x), abs=1e-6)
        assert (got[i]["n_known"], got[i]["held_out"]) == (sum(uni[(w,)] > 0 for w in x), not train(i))


def test_lm_groups_and_finds_keys_without_stable_sorts():
    r = np.random.default_rng(5)
    ends = np.array([-(2**63), -1, 0, 2**63 - 1])
    some = np.concatenate([r.integers(-(2**63), 2**63 - 1, 3000), ends])
    for key in (r.choice(some, 9000), ends[:1], ends[:0]):
        order, start = lm_scoring._groups(key)
        uniq, count = np.unique(key, return_counts=True)
        assert np.array_equal(key[order[start]], uniq)
        assert np.array_equal(np.add.reduceat(np.ones(len(key), np.int64)[order], start), count)
        want = r.permutation(np.concatenate([some, r.integers(-(2**63), 2**63 - 1, 500)]))
        hit, pos = lm_scoring._found(uniq, lm_scoring._starts(uniq), want)
        assert np.array_equal(hit, np.isin(want, uniq)) and np.array_equal(uniq[pos], want[hit])
        by = np.sort(key.view(np.uint64)).view(np.int64)
        num = np.arange(len(by)) * 70001
        got = lm_scoring.unpack(lm_scoring.pack(by, num), 1)
        assert np.array_equal(got[0], by) and np.array_equal(got[1], num.astype(np.uint32))


def test_substring_dedup_equals_brute_force(spark):
    base = ["".join(chr(97 + (i * 7919 + j * j * 31 + i * j) % 26) for j in range(900)) for i in range(3)]
    texts = ["", None, "z" * 900, base[0], base[0], base[1][:500] + base[0][100:600], "é" * 300, "Der " * 250, base[2] + base[2][:420]]
    data = [(t or "").encode() for t in texts]
    c = Counter(t[p : p + 400] for t in data for p in range(len(t) - 399))
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(data):
        runs = substring_dedup.merged((p, p + 400) for p in range(len(t) - 399) if c[t[p : p + 400]] > 1)
        assert (got[i]["n_removed"], got[i]["n_spans"]) == (sum(b - a for a, b in runs), len(runs)), i
        assert got[i]["kept_sha256"] == hashlib.sha256(substring_dedup.cut(t, runs)).hexdigest()
    order = substring_dedup.corpus_order([b"banana bandana", b"ananas"], substring_dedup.Unit(12, 3))
    assert order == sorted(order, key=lambda x: ([b"banana bandana", b"ananas"][x[0]][x[1] :], x[0]))


def test_one_parse_serves_bytes_and_words(spark):
    """Both kinds against brute force: passages with other white space, long words, few triggers."""
    r = np.random.default_rng(4)
    word = lambda a, b: "".join(chr(97 + x) for x in r.integers(0, 26, int(r.integers(a, b))))
    short, wide = [word(1, 5) for _ in range(60)], [word(30, 60) for _ in range(14)]
    fill = lambda n: " ".join(word(1, 9) for _ in range(n))
    texts = [f"{fill(30)} {' '.join(short)}\n{fill(9)}", f"{fill(3)}\t{'  '.join(short)}", f"x{' '.join(short)}y {fill(70)}"]
    texts += [f"{fill(4)} {' '.join(wide)} {fill(20)}", f"{' '.join(wide)}", f"{fill(80)} {' '.join(wide)}", " " * 1000, fill(5) + " " * 500 + fill(60), "ab " * 300, "", None]
    data = [(t or "").encode() for t in texts]
    grams = Counter(t[p : p + 400] for t in data for p in range(len(t) - 399))
    words = [[(m.start(), m.end()) for m in re.finditer(rb"[^\t-\r ]+", t)] for t in data]
    runs_of = lambda t, w: [(tuple(t[a:b] for a, b in w[i : i + 50]), w[i][0], w[i + 49][1]) for i in range(len(w) - 49)]
    runs = Counter(g for t, w in zip(data, words) for g, _, _ in runs_of(t, w))
    rows, cuts = substring_dedup.cuts_by_kind(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ((400, substring_dedup.BYTES), (50, substring_dedup.WORDS)))
    for k, cut in enumerate(cuts):
        got = {x["doc_id"]: (x["removed"], x["spans"], x["left_sha"]) for x in rows.join(cut, ["x1", "x2"]).collect()}
        for i, t in enumerate(data):
            spans = [(p, p + 400) for p in range(len(t) - 399) if grams[t[p : p + 400]] > 1] if k == 0 else [(a, b) for g, a, b in runs_of(t, words[i]) if runs[g] > 1]
            spans = substring_dedup.merged(spans)
            want = (sum(b - a for a, b in spans), hashlib.sha256(substring_dedup.cut(t, spans)).hexdigest())
            assert (got[i][0], got[i][2]) == want if spans else i not in got, (k, i)
        assert len(got) == (6, 4)[k]  # words: the passage in three texts, and "ab" over and over


def test_repeated_spans_sort_no_texts(spark, capsys):
    text = " ".join(f"w{i * i % 97}{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " x")], "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, _, (found,) = substring_dedup.repeated_spans(docs)
        found.explain()
        assert "ShuffledHashJoin" in (plan := capsys.readouterr().out) and "SortMergeJoin" not in plan
        assert found.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_op5_reports_passages_of_fifty_words(spark, tmp_path):
    short = " ".join(f"a{i}" for i in range(52))  # under 400 bytes
    texts = [f"{short} tail one", f"head {short}", "other text " * 3, None, "", short[:150], "x " * 60]
    extra = [(i, t, 1, "kept") for i, t in enumerate(texts)]
    spark.createDataFrame(extra, "doc_id long, text string, n long, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_substring_dedup"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and all(r["n_removed"] == 0 for r in got.values())
    assert [got[i]["passage_bytes"] for i in range(len(texts))] == [len(short), len(short), 0, 0, 0, 0, 119]


def test_near_duplicates_edges(spark, edge):
    got = near_duplicates.near_duplicates(edge).collect()
    assert len(got) == len(EDGE)
    assert sorted(r["n_links"] for r in got if r["doc_id"] == 3) == [1, 1]
    assert {r["class_id"] for r in got if r["doc_id"] in (None, 6)} == {6}
    assert {r["n_links"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert near_duplicates.drop_near_duplicates(edge).count() == 5
    assert near_duplicates.near_duplicates(edge.limit(0)).count() == 0


def test_components_settle_or_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r["root"] for r in common.connected_components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        common.connected_components(path, max_rounds=1)


@pytest.mark.parametrize("size", [200, 3 * 10**7, 10**9, 5 * 10**9])
def test_topk_block_is_exact_for_any_components(size):
    r = np.random.default_rng(size)
    vecs = r.integers(-size, size, (300, 24), endpoint=True)
    vecs[50:60] = vecs[40]  # ties
    vecs[60:70] = vecs[40]
    vecs[60:70, 0] += np.arange(10)  # scores that differ by little
    ids = np.arange(300) * 3
    at, got, score = topk_search.search_block(topk_search.build_block(ids, vecs.astype(float)), vecs[::15].astype(float), ids[::15], 20)
    assert len(at) == 20 * 20
    for q in range(20):
        want = sorted((-min(max(sum(int(a) * int(b) for a, b in zip(vecs[q * 15], v)), -(2**63)), 2**63 - 1), int(i)) for i, v in zip(ids, vecs) if i != ids[q * 15])[:20]
        assert [(-int(s), int(i)) for s, i in zip(score[at == q], got[at == q])] == want


def test_decontamination(spark):
    item = "the quick purple walrus measured seventeen copper kettles. then it sang about distant rivers"
    docs = [(i, " ".join(f"w{(i * 31 + j * 7) % 997}" for j in range(300))) for i in range(80)]
    docs += [(100, docs[0][1] + " " + item + " " + docs[1][1]), (101, item.replace("purple", "violet").replace("copper", "brass")), (102, None), (103, "")]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(100, 1), (101, 1)}
    assert decontaminate.lcs_length(list("abcde"), list("axcxe")) == 3


def test_decontamination_of_an_item_in_a_third_of_the_rows(spark):
    item = "the quick purple walrus measured seventeen copper kettles. then it sang about distant rivers"
    text = lambda i: " ".join(f"w{(i * 31 + j * 7) % 997}" for j in range(120))
    docs = [(i, f"{text(i)} {item} {text(i + 1)}" if i % 3 == 0 else text(i)) for i in range(96)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"] for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == set(range(0, 96, 3))


def test_latent_space_is_fitted_on_the_passages_of_all_documents(spark):
    r = np.random.default_rng(3)
    D = decontaminate
    vocab = {f"w{i}".encode(): i for i in range(300)}
    # many and long texts (over 16,000 bytes), short, empty and unknown ones; frequent words
    sizes = [*r.integers(0, 120, 4500).tolist(), 40_000, 6_000, 0, 1, 15, 16, 17, 48, 64, 65]
    texts = [[f"w{int(x)}" for x in np.minimum(r.zipf(1.3, n), 400)] for n in sizes] + [["x"] * 70]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string").repartition(3)
    coded, kind = D._encoded(df, vocab)
    freq, n = D.document_frequencies(coded, len(vocab), kind)
    assert n == len(texts) + 1 and freq.tolist() == [sum(w.decode() in t for t in map(set, texts)) for w in vocab]

    idf = np.log((n + 1) / (freq + 1)) + 1

    def passages(words):
        ids = [vocab.get(w.encode(), -1) for w in words]
        last = max((i for i, x in enumerate(ids) if x >= 0), default=-1)
        strides = np.zeros((last // D.STRIDE + 1, len(vocab)))
        for i, x in enumerate(ids[: last + 1]):
            strides[i // D.STRIDE, x] += x >= 0
        return [strides[i : i + D.LONG].sum(0) for i in range(max(1, len(strides) - D.LONG + 1))] if last >= 0 else []

    m = np.array([p for t in texts for p in passages(t)]) * idf
    own = [np.arange(5, 25), np.arange(100, 103)]
    mine = np.array([p for o in own for p in passages([f"w{i}" for i in o])]) * idf
    table = r.standard_normal((len(vocab), 20))
    got = D._sum_products(coded, kind, idf, own)(table)
    want = m.T @ (m @ table) / len(m) + mine.T @ (mine @ table) / len(mine)
    assert np.abs(got - want).max() < 1e-4 * np.abs(want).max()
    # the two products find the leading space of a symmetric matrix
    basis = np.linalg.qr(r.standard_normal((300, 300)))[0]
    a = basis @ np.diag(0.8 ** np.arange(300)) @ basis.T
    assert np.abs(np.abs((D.randomised_svd(lambda q: a @ q, 300, 8)).T @ basis[:, :8]) - np.eye(8)).max() < 1e-3


def test_decontamination_against_brute_force(spark):
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    items = {i: [str(w) for w in r.choice(words, int(r.integers(12, 61)))] for i in range(30)}
    docs = {}
    for d in range(240):
        text = [str(w) for w in r.choice(words, int(r.integers(0, 700)))]
        if d % 2:
            item = items[d % 30]
            changed = r.random(len(item)) < (0.25 if d % 3 == 0 else 0.1 if d % 3 == 1 else 0)
            item = [f"x{d}" if c else w for w, c in zip(item, changed)]
            at = (0, len(text), len(text) // 2)[d % 5 % 3]  # first, last and inner words of a text
            text[at:at] = item
        docs[d] = text
    docs[240] = []
    docs[241] = items[7][:-1]

    def share(item, text):
        n = len(item)
        return max((decontaminate.lcs_length(item, text[s : s + n + n // 4 + 4]) / n for s in range(len(text))), default=0)

    possible = {(d, i) for d, text in docs.items() for i, item in items.items() if len(set(item) & set(text)) >= 0.5 * len(set(item))}
    shares = {(d, i): share(items[i], docs[d]) for d, i in possible}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()] + [(99, "?!")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_contamination(df, bench).collect()}
    assert {p for p, s in shares.items() if s == 1} <= got <= {p for p, s in shares.items() if s >= decontaminate.MIN_LCS}
    sure = {p for p, s in shares.items() if s >= decontaminate.SURE_LCS}
    assert len(sure) > 60 and len(sure & got) >= 0.97 * len(sure)
    assert decontaminate.find_contamination(df, bench.limit(0)).count() == 0 == decontaminate.find_contamination(df.limit(0), bench).count()


def test_mixing_meets_targets(spark):
    docs = [(i, "plain words here. " * (3 + i % 5)) if i % 3 else (i, "JUNK*** THING$$$ MORE### " * (3 + i % 5)) for i in range(120)]
    df = spark.createDataFrame([*docs, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120, 2)], "doc_id long, quality int")
    got = mixing.mix(df, labels, {1: 0.9, 0: 0.1}).toPandas()
    total = got.n_tokens.sum()
    assert (got.rate >= 0).all()
    assert abs((got.rate * got.n_tokens * got.p_1).sum() - 0.9 * total) < 0.02 * total
    assert mixing.mix(df, labels.limit(0), {1: 1.0}).count() == 121


def test_mixing_reads_a_text_twice(spark):
    texts = [None, "", " \x0b\x0c a\rb\t\n", "\u00e9A1!\U0001f600#  b c \n\n", "-a^|]\\[`_/+x", "   ", "x ", "ABC 0129.,;:?\"'()-*#&$%@{}<>|=~^!\n"]
    got = mixing._measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in got.collect():
        t = texts[r["doc_id"]] or ""
        n, words = max(len(t), 1), re.sub("[ \t\n\r\f\x0b]+", " ", t).split(" ")
        share = {c: sum(x in chars for x in t) / n for c, chars in mixing.COUNTED.items()}
        assert r["n_tokens"] == sum(w != "" for w in words) and r["letters"] == t.count(" ") / n
        assert r["upper"] == share["upper"] and r["symbols"] == min(share["symbols"] * 10, 1) and r["bang"] == min(share["bang"] * 10, 1)
        assert all(r[c] == share[c] * 10 for c in ("digits", "marks", "lines"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.findall(r"(?:translate|split)\((?:coalesce\()?text#", plan) and len(re.findall(r"regexp_replace\(coalesce\(text#", plan)) == 2


def test_toxicity_learns(spark):
    r = np.random.default_rng(0)
    words = [f"word{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(words, 60)) + (" awful scumbag" if i % 2 else " nice friend")) for i in range(300)]
    df = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, labels, F.col("doc_id") % 5 != 0).toPandas().set_index("doc_id")
    held = [i for i in range(300) if i % 5 == 0]
    assert np.mean([got.predicted[i] == i % 2 for i in held]) > 0.9
    assert got.score[900] == 0 and got.score[901] == 0


def test_token_counts_equal_library(spark, edge):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = str(P.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    more = spark.createDataFrame([(i, t, "") for i, t in enumerate(["  a  b ", "▁x\n y", "\t", "<s> é", "a\u3000b  "], 20)], edge.schema)
    for r, (d, t) in zip(token_counts.count_tokens(edge.union(more).coalesce(1), path).collect(), [*EDGE, *[(x["doc_id"], x["text"]) for x in more.collect()]]):
        assert (r["n_tokens"], r["n_bytes"]) == (len(sp.encode(t or "")), len((t or "").encode()))
