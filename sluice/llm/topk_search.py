"""Exact top-k inner products over an impact-ordered index, score at a time.

Index: rows are dealt to blocks of bounded size. A block's postings (dimension,
row, quantised value) are cut into segments by impact level, the magnitude of the
quantised value; segments are stored by descending impact, each as dimension, row
and value arrays. Search: for a block of queries, segments are added to the score
accumulators level by level. After each level a row can still gain at most
``|q| * r`` (Cauchy-Schwarz, r the norm of the row's unprocessed values), so rows
whose accumulator plus that bound stays under the k-th best lower bound are proved
out. Processing stops once few possible members are left, or no segment is; the
members are then rescored exactly, in doubles where these hold each sum, else in
integers.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows of an index block; queries of a query block; rows left per query when processing stops.
BLOCK_ROWS, QUERY_ROWS, STOP_AT = 16384, 512, 64
LEVELS = 6
LONG = 1 << 63


def build_block(ids: np.ndarray, vecs: np.ndarray, levels: int = LEVELS) -> dict:
    """Segments of a block by descending impact; vecs is (rows, dims) of whole numbers."""
    mag = np.abs(vecs)
    top = float(mag.max()) if mag.size else 0.0
    # level bounds fall geometrically: the long tail of small impacts comes last
    bounds = [top * 0.7**i for i in range(1, levels)] + [0.0]
    segments, upper = [], np.inf
    for low in bounds:
        row, dim = np.nonzero((mag > low) & (mag <= upper))
        segments.append((low, dim.astype(np.int32), row.astype(np.int32), vecs[row, dim]))
        upper = low
    return {"ids": ids, "dims": vecs.shape[1] if vecs.ndim == 2 else 0, "segments": segments}


def _exact(a: np.ndarray, b: np.ndarray, doubles: bool) -> np.ndarray:
    """Inner products of whole-numbered rows; beyond 64 bits the nearest long."""
    if doubles:  # every partial sum is below 2^53
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    sums = (sum(int(x) * int(y) for x, y in zip(r, t)) for r, t in zip(a.tolist(), b.tolist()))
    return np.array([min(max(v, -LONG), LONG - 1) for v in sums], np.int64)


def search_block(block: dict, queries: np.ndarray, query_ids: np.ndarray, k: int, stop_at: int = STOP_AT):
    """(query index, row id, score) of each query's exact top k of the block, own rows left out."""
    ids, segments = block["ids"], block["segments"]
    n, d = len(ids), block["dims"]
    m = len(queries)
    if not n or not m:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if queries.shape[1] < d:
        queries = np.pad(queries, ((0, 0), (0, d - queries.shape[1])))
    queries = queries[:, :d]
    full = np.zeros((n, d))
    for _, dim, row, val in segments:
        full[row, dim] = val
    peak = float(np.abs(queries).max(initial=0) * np.abs(full).max(initial=0)) * max(d, 1)
    kind = np.float32 if peak < 2**23 else np.float64
    q = queries.astype(kind)
    q_norm = np.sqrt((queries**2).sum(1))
    rest = (full**2).sum(1)
    # what rounding may add to or take from a sum of doubles
    slack = 0.0 if peak < 2**53 else 4e-16 * (d + len(segments)) * q_norm[:, None] * np.sqrt(rest)[None, :]
    scores = np.zeros((m, n), kind)
    own = query_ids[:, None] == ids[None, :]
    kth = min(k, n) - 1
    for level, (_, dim, row, val) in enumerate(segments):
        if len(val):
            plane = np.zeros((n, d), kind)
            plane[row, dim] = val
            scores += q @ plane.T
            rest = np.maximum(rest - (plane.astype(np.float64) ** 2).sum(1), 0)
        last = level == len(segments) - 1
        gain = (q_norm[:, None] * np.sqrt(rest)[None, :] * (1 + 1e-6) + 1e-3 * (rest > 0) + slack).astype(kind)
        if not last:
            low = np.where(own, -np.inf, np.clip(scores - gain, -float(LONG), float(LONG)))
            bar = np.partition(low, n - 1 - kth, axis=1)[:, n - 1 - kth]
            alive = (np.clip(scores + gain, -float(LONG), float(LONG)) >= bar[:, None]) & ~own
            if level < len(segments) // 2 or alive.sum() > m * max(stop_at, 2 * k):
                continue
        else:
            held = np.where(own, -np.inf, np.clip(scores - slack, -float(LONG), float(LONG)))
            bar = np.partition(held, n - 1 - kth, axis=1)[:, n - 1 - kth]
            alive = (np.clip(scores + slack, -float(LONG), float(LONG)) >= bar[:, None]) & ~own
        break
    at, who = np.nonzero(alive)
    exact = np.empty(len(at), np.int64)
    for i in range(0, len(at), 1 << 16):
        c = slice(i, i + (1 << 16))
        exact[c] = _exact(queries[at[c]], full[who[c]], peak < 2**53)
    order = np.lexsort((ids[who], ~exact, at))  # ~ falls as the score rises, at either bound too
    at, who, exact = at[order], who[order], exact[order]
    start = np.searchsorted(at, np.arange(m))
    keep = np.arange(len(at)) - start[at] < k
    return at[keep], ids[who[keep]], exact[keep]


def _pack(batches: list[tuple], width: int) -> np.ndarray:
    out = np.zeros((len(batches), width))
    for i, v in enumerate(batches):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, k: int = 20, query_mod: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query row, by all rows but its own.

    Components become floor(scale * x). Queries are the rows whose id is divisible by
    ``query_mod``. Rows with a null id, a null vector, or null or non-finite components
    take no part. Vectors of unequal length count as padded with zeros; rows with the
    query's id are its own; a repeated id is returned once for each of its rows, and a
    repeated query id is one query (its least vector by content). Fewer than k rows
    give fewer results; an empty table gives none. Scores beyond 64 bits count as the
    nearest long. Other columns are ignored.

    Plan: rows are dealt by a hash over id and content to blocks of bounded size, and
    query blocks (bounded too) are sent to every index block: a stated query set
    against all rows. No block depends on a key's frequency. Each pair of blocks
    returns at most k rows per query, merged by one window over the query id.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    n = src.count()
    blocks, deal = max(1, -(-n // BLOCK_ROWS)), F.xxhash64("id", "v")
    dealt = src.withColumn("block", F.pmod(deal, F.lit(blocks)).cast("int"))

    def index(pdf):
        width = int(pdf["v"].map(len).max())
        made = build_block(pdf["id"].to_numpy(np.int64), _pack(list(pdf["v"]), width))
        import pandas as pd

        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "index": [pickle.dumps(made, 5)]})

    parts = max(blocks, 1)
    indexed = dealt.repartition(parts, "block").groupBy("block").applyInPandas(index, "block int, index binary")
    queries = src.where(F.pmod("id", F.lit(query_mod)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    groups = max(1, -(-(n // max(query_mod, 1)) // QUERY_ROWS))
    asked = queries.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))

    def pack(pdf):
        import pandas as pd

        width = int(pdf["v"].map(len).max())
        body = pickle.dumps((pdf["id"].to_numpy(np.int64), _pack(list(pdf["v"]), width)), 5)
        return pd.DataFrame({"asked": [body]})

    packed = asked.groupBy("g").applyInPandas(pack, "asked binary")
    sent = packed.select("asked", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = indexed.join(sent, "block").select("index", "asked")

    def run(batches):
        last, block = None, None
        for b in batches:
            for raw, ask in zip(b.column(0), b.column(1)):
                body = raw.as_buffer()
                if last is None or not body.equals(last):
                    last, block = body, pickle.loads(body)
                q_ids, q = pickle.loads(ask.as_buffer())
                for i in range(0, len(q_ids), 256):
                    at, ids, score = search_block(block, q[i : i + 256], q_ids[i : i + 256], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids[i : i + 256][at]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"]
                    )

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
