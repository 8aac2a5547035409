"""N-gram Jaccard self-join by MinHash banding, verified on the full shingle sets.

Shingles are runs of five words (lower-cased, between white space); a shorter text
is one shingle of all its words. ``bands`` and ``rows`` follow from the target recall.
Documents with equal shingle sets are one class, joined by its representative only.
Representatives that share a band are connected into candidate groups; a group's sets
meet in one task (large groups in a grid of bounded tiles), where the pairs that
share a band are verified exactly. Links are counted, not listed: a group of near
copies costs no row per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .spans import SpanHasher, mix

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: rows per band: more make chance candidates rarer and need more bands.
ROWS = 8
#: representatives, and shingles, that meet in one tile.
TILE, TILE_SHINGLES = 1024, 2_000_000
_HASHER = SpanHasher()


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """Least number of bands that finds a pair at ``threshold`` with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; empty if it has no word."""
    norm = b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) if text else b""
    if not norm:
        return np.empty(0, np.uint64)
    data = np.frombuffer(norm, np.uint8)
    gap = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], gap + 1]), np.append(gap, len(data))
    if len(start) > words:
        start, end = start[: 1 - words], end[words - 1 :]
    else:
        start, end = start[:1], end[-1:]
    return np.unique(_HASHER.spans(_HASHER.prefix(data), start, end))


class MinHasher:
    """Band keys of shingle sets."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = 5):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (r.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = r.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)[:, None]
        self.salt = r.integers(1, 1 << 63, bands, dtype=np.uint64)

    def keys(self, sets: np.ndarray) -> np.ndarray:
        low = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
        best = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), 256):
            v = self.a * low[i : i + 256]
            v += self.b
            np.minimum(best, v.min(1), out=best)
        out = self.salt.copy()
        for i in range(self.rows):
            out = mix(out ^ best[i :: self.rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
        return out.view(np.int64)


def text_keys(text):
    """128-bit identity of a text as two native hashes; a null text counts as the empty one."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(t).alias("x1"), F.xxhash64(F.lit("second"), t).alias("x2")


def signatures(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """uid, doc_id, x1, x2, n, f1, f2 (set identity), keys of every row."""
    hasher_args = (bands, rows)

    def run(batches):
        hasher = MinHasher(*hasher_args)
        for b in batches:
            n, f1, f2, keys = [], [], [], []
            for t in b.column(4).to_pylist():
                s = shingles(t, words)
                n.append(len(s))
                f1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                f2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                keys.append(hasher.keys(s) if len(s) else np.empty(0, np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(4)), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                names=["uid", "doc_id", "x1", "x2", "n", "f1", "f2", "keys"],
            )

    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), *text_keys(F.col("text")), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "uid long, doc_id long, x1 long, x2 long, n long, f1 long, f2 long, keys array<long>")


def verify_tile(uids: np.ndarray, side: np.ndarray, weight: np.ndarray, keys: list[np.ndarray], sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weighted links, root position) per row of a tile.

    Pairs of rows that share a band key are candidates. ``side`` 0 and 1 are the two
    halves of an off-diagonal grid tile, of which only cross pairs count; 2 is a tile
    of its own. Exact: |A and B| / |A or B| >= threshold.
    """
    m = len(uids)
    links, root = np.zeros(m, np.int64), np.arange(m)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    flat = np.concatenate(keys) if m else np.empty(0, np.int64)
    owner = np.repeat(np.arange(m), [len(k) for k in keys])
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(flat)))
    packs, held = [np.empty(0, np.int64)], 0

    def squeeze():
        packs[:] = [np.unique(np.concatenate(packs))]
        return len(packs[0])

    for s, k in zip(first[size > 1], size[size > 1]):
        who = owner[s : s + k]
        i, j = np.triu_indices(k, 1)
        packs.append(who[i].astype(np.int64) * m + who[j])
        held += len(i)
        if held > 4_000_000:  # all pairs of a tile are at most TILE squared
            held = squeeze()
    squeeze()
    a, b = packs[0] // m if m else packs[0], packs[0] % m if m else packs[0]
    keep = (side[a] != side[b]) | (side[a] == 2)
    a, b = a[keep], b[keep]
    n = np.array([len(s) for s in sets])
    # the sizes alone rule out many pairs
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    keep = small >= threshold * large
    a, b = a[keep], b[keep]
    if not len(a):
        return links, root
    both = _intersections(a, b, sets, n)
    union = n[a] + n[b] - both
    hit = both >= threshold * union - 1e-9
    for i, j in zip(a[hit], b[hit]):
        links[i] += weight[j]
        links[j] += weight[i]
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
    return links, np.array([find(i) for i in range(m)])


def _intersections(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    if len(a) <= 4096:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)])
    # many pairs: products of the 0/1 matrix over the shingles that two or more rows hold
    used = np.unique(np.concatenate([a, b]))
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), n[used])
    values, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
    col = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[inv]
    owner, col = owner[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    total = np.zeros((len(used), len(used)), np.float32)
    width = 4096
    top = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, top, width):
        s, e = np.searchsorted(col, (lo, lo + width))
        rows = np.unique(owner[s:e])
        x = np.zeros((len(rows), width), np.float32)
        x[np.searchsorted(rows, owner[s:e]), col[s:e] - lo] = 1
        total[np.ix_(rows, rows)] += x @ x.T
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    return total[place[a], place[b]].astype(np.int64)


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, rows: int = ROWS, tile: int = TILE, tile_shingles: int = TILE_SHINGLES
) -> DataFrame:
    """doc_id, class_id, n_links, keep (and x1, x2, the text's identity) for every row.

    Two documents are linked if the Jaccard similarity of their shingle sets reaches
    ``threshold``; class_id is the least doc_id of all documents connected by links
    (null if all of them are null), n_links counts the documents linked to the row,
    copies included. ``keep`` marks one row of each class: the first by doc_id.
    Texts without a word (null, empty, blank) have no link and are a class of their
    own each, with their own doc_id. Repeated rows are copies. Other columns are ignored.

    Scale: representatives move once as band keys and once as sets, each in
    proportion to the input. Hot classes and bands are pre-aggregated (min, count);
    joins on them carry ids only and are split by AQE. A candidate group of m sets
    beyond a tile is copied m / tile times, which covers its pairs exactly without a cap.
    """
    bands = bands_for(threshold, rows, recall)
    sigs = common.written(signatures(docs, bands, rows, words), "nd-signatures")
    # Classes and groups of one row need no join. The others' rows are stored first, so that both
    # sides of the join come straight from a shuffle and AQE can split the rows of a hot one.
    classes = sigs.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("w"))
    classes = common.written(classes.where("w > 1"), "nd-classes")
    lone = F.coalesce(F.col("rep"), F.col("uid"))
    members = sigs.join(classes, ["f1", "f2", "n"], "left").select(
        "uid", "doc_id", "x1", "x2", "n", lone.alias("rep"), F.coalesce("w", F.lit(1)).alias("w"), F.when((F.col("uid") == lone) & (F.col("n") > 0), F.col("keys")).alias("keys")
    )
    members = common.written(members, "nd-members")
    common.discard(sigs, classes)
    reps = members.where("uid = rep and n > 0")
    band = reps.select("uid", F.explode("keys").alias("key"))
    hubs = band.groupBy("key").agg(F.min("uid").alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", "hub")
    edges = band.join(hubs, "key").where("uid <> hub").select(F.col("uid").alias("a"), F.col("hub").alias("b"))
    groups = common.connected_components(edges)
    found = _verified(docs, reps, groups, threshold, words, tile, tile_shingles)
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    final = common.connected_components(found.where("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b")))
    # a row per representative that has links, then the least id of each class
    info = members.join(links.withColumnRenamed("uid", "rep"), "rep", "left").join(final.select(F.col("node").alias("rep"), "root"), "rep", "left")
    info = info.select("uid", "doc_id", "x1", "x2", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    info = common.written(info, "nd-links")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first")
    several = info.groupBy("root").agg(first, F.count("*").alias("c")).where("c > 1").select("root", F.col("first.doc_id").alias("class_id"), F.col("first.uid").alias("first_uid"))
    out = info.join(common.written(several, "nd-several"), "root", "left")
    one = F.col("first_uid").isNull()
    return out.select("doc_id", F.when(one, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links", (one | (F.col("uid") == F.col("first_uid"))).alias("keep"), "x1", "x2")


def _verified(docs: DataFrame, reps: DataFrame, groups: DataFrame, threshold: float, words: int, tile: int, tile_shingles: int) -> DataFrame:
    """(uid, links, root) from every tile."""
    wanted = reps.join(groups.withColumnRenamed("node", "uid"), "uid").select("uid", "root", "doc_id", "x1", "x2", "n", "w", "keys")
    wanted = common.written(wanted, "nd-wanted")
    sizes = wanted.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    tiles = F.greatest(F.ceil(F.col("c") / tile), F.ceil(F.col("s") / tile_shingles)).cast("int")
    sizes = sizes.select("root", tiles.alias("tiles"))
    total, shingle_total = wanted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    packs = max(1, -(-total // tile), -(-shingle_total // tile_shingles))
    big = sizes.where("tiles > 1")
    placed = wanted.join(big, "root", "left")
    t, mine = F.col("tiles"), F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int")
    # grid tile (i, j), i <= j, as text; a small group goes whole to a pack by its root
    grid = F.transform(F.sequence(F.lit(0), t - 1), lambda o: F.struct(
        F.concat_ws("-", F.lit("g"), F.col("root").cast("string"), F.least(mine, o).cast("string"), F.greatest(mine, o).cast("string")).alias("place"),
        F.when(mine == o, F.lit(2)).when(mine < o, F.lit(0)).otherwise(F.lit(1)).alias("side")))
    pack = F.array(F.struct(F.concat(F.lit("p-"), F.pmod(F.xxhash64("root"), F.lit(packs)).cast("string")).alias("place"), F.lit(2).alias("side")))
    placed = placed.withColumn("at", F.when(t.isNull(), pack).otherwise(grid)).drop("root", "tiles", "n")
    src = docs.select(F.col("doc_id").cast("long").alias("d"), *text_keys(F.col("text")), F.col("text").cast("string").alias("text"))
    p = placed.select("uid", F.col("doc_id").alias("pd"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), "w", "keys", "at")
    near = common.thinned(src, "x1", wanted.select(F.col("x1").alias("p1")), "p1")
    joined = near.join(p, (F.col("x1") == F.col("p1")) & (F.col("x2") == F.col("p2")) & F.col("d").eqNullSafe(F.col("pd"))).select("uid", "w", "keys", "at", "text")

    def to_sets(batches):
        for b in batches:
            sets = [shingles(x, words).tobytes() for x in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(sets, pa.binary())], names=["uid", "w", "keys", "at", "set"])

    sets = joined.mapInArrow(to_sets, "uid long, w long, keys array<long>, at array<struct<place: string, side: int>>, set binary")
    dealt = sets.select("uid", "w", "keys", "set", F.explode("at").alias("x")).select("uid", "w", "keys", "set", "x.place", "x.side")

    def check(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("uid")  # repeated rows fetch their text twice
        uids = pdf["uid"].to_numpy(np.int64)
        got = [np.frombuffer(s, np.uint64) for s in pdf["set"]]
        links, root = verify_tile(uids, pdf["side"].to_numpy(), pdf["w"].to_numpy(np.int64), [np.asarray(k, np.int64) for k in pdf["keys"]], got, threshold)
        return pd.DataFrame({"uid": uids, "links": links, "root": uids[root]})

    return common.written(dealt.groupBy("place").applyInPandas(check, "uid long, links long, root long"), "nd-verified")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all its columns) without all but one of each class."""
    marks = near_duplicates(docs, **options)
    marks = common.written(marks.select("doc_id", "x1", "x2", "keep"), "nd-marks")
    keys = ["doc_id", "x1", "x2"]
    per = marks.groupBy(*keys).agg(F.count_if("keep").alias("k"), F.count("*").alias("c"))
    gone = per.where("k = 0").select(F.col("doc_id").alias("_gd"), F.col("x1").alias("_g1"), F.col("x2").alias("_g2"))
    twice = per.where("k > 0 and c > k").limit(1).count() > 0
    x1, x2 = text_keys(F.col("text"))
    keyed = docs.withColumns({"_x1": x1, "_x2": x2})
    out = keyed.join(gone, (F.col("_x1") == F.col("_g1")) & (F.col("_x2") == F.col("_g2")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_gd")), "left_anti")
    if twice:  # repeated rows share their key with the one that stays
        w = Window.partitionBy("doc_id", "_x1", "_x2").orderBy(F.lit(1))
        worded = F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))) > 0
        out = out.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~worded).drop("_n")
    return out.select(*docs.columns)
