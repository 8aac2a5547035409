"""Pairs within groups of bounded size that satisfy several inequalities, counted on sorted partitions.

A row is a point as s, as t, or both. Points stand in the order of one inequality; each of
the others is a tree over the ranks of its values within the group, in which an s and a t
of different rank part at exactly one node. Only the points that count at a node are kept,
so nothing is copied to disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: rows whose pairs are counted at once, and most rows of a group that is not parted.
CHUNK = 1 << 17


def _ordered(c: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers in the order of the values (as Spark orders them); what a null gets has no meaning."""
    if pa.types.is_floating(c.type):
        x = pc.fill_null(c, 0.0).to_numpy().astype(np.float64) + 0.0  # -0.0 equals 0.0
        bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
        return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))
    if pa.types.is_temporal(c.type):
        c = c.cast(pa.int32() if c.type.bit_width == 32 else pa.int64())
    if pa.types.is_integer(c.type) or pa.types.is_boolean(c.type):
        return pc.fill_null(c, False if pa.types.is_boolean(c.type) else 0).to_numpy().astype(np.int64)
    coded = c.combine_chunks().dictionary_encode()
    rank = np.empty(len(coded.dictionary) + 1, np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    return rank[pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy()]


def _ranks(group: np.ndarray, left: np.ndarray, right: np.ndarray, op: str, s: np.ndarray) -> np.ndarray:
    """Ranks within the groups, such that an s is above a t where its value stands in ``op`` to t's."""
    value = np.concatenate([left, right])
    if op in ("<", "<="):
        value = ~value  # turns the order, without overflow
    code = np.unique(value, return_inverse=True)[1]
    code = (group * (int(code.max()) + 1) + code) * 2
    if op in ("<=", ">="):
        code += s  # of equal values s is above
    order = np.argsort(code)
    code, group = code[order], group[order]
    dense = np.cumsum(np.r_[0, code[1:] != code[:-1]])
    first = np.r_[True, group[1:] != group[:-1]]
    out = np.empty_like(dense)
    out[order] = dense - np.maximum.accumulate(np.where(first, dense, 0))
    return out


def _above(node: np.ndarray, s: np.ndarray, dims: list[np.ndarray]) -> int:
    """Pairs of a node with s above t in all of ``dims`` and s after t in the points' order."""
    if not len(s):
        return 0
    room = (len(s) - 1).bit_length()
    if dims:
        rank, rest = dims[0], dims[1:]
        bits = int(rank.max()).bit_length()
        if int(node.max()).bit_length() + bits + room > 62:
            node = np.unique(node, return_inverse=True)[1]
        total = 0
        for i in range(bits):
            keep = np.flatnonzero(((rank >> i) & 1 == 1) == s)
            total += _above((node[keep] << (bits - i - 1)) | (rank[keep] >> (i + 1)), s[keep], [d[keep] for d in rest])
        return total
    key = np.sort((node << room) | np.arange(len(s)))  # by node, the order kept
    s, node = s[key & ((1 << room) - 1)], key >> room
    seen = np.cumsum(~s)
    first = np.r_[True, node[1:] != node[:-1]]
    before = np.maximum.accumulate(np.where(first, seen - ~s, 0))
    return int((seen - before)[s].sum())


def pairs(rows: pa.Table, keys: list[str], order: list[tuple[str, str, str]]) -> int:
    """Pairs of an s and a t of one group that satisfy every (left, right, operator). Equal keys stand
    together; ``_side`` has bit 1 for an s and bit 2 for a t, whose columns are not null."""
    side = rows["_side"].to_numpy()
    group = np.cumsum(np.r_[0, _changes(rows, keys)])
    a, b = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    if not len(a) or not len(b):
        return 0
    group = np.concatenate([group[a], group[b]])
    s = np.arange(len(group)) < len(a)
    value = {c: _ordered(rows[c]) for c in {x for left, right, _ in order for x in (left, right)}}
    dims = sorted((_ranks(group, value[left][a], value[right][b], op, s) for left, right, op in order), key=lambda d: int(d.max()))
    last = dims.pop()
    at = np.argsort((group * (int(last.max()) + 1) + last) * 2 + ~s)  # of equal rank s goes first
    return _above(group[at], s[at], [d[at] for d in dims])


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row's key differs from that of the row before, from the second row on."""
    out = np.zeros(max(rows.num_rows - 1, 0), bool)
    for k in keys:
        x = _ordered(rows[k])
        out |= x[1:] != x[:-1]
    return out


def counter(keys: list[str], order: list[tuple[str, str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over partitions sorted by the keys: ``n`` of one chunk of whole groups after another."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        many = 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many < CHUNK:
                continue
            rows = pa.Table.from_batches(held)
            ends = np.flatnonzero(_changes(rows, keys))
            if len(ends):
                cut = int(ends[-1]) + 1
                yield _row(pairs(rows.slice(0, cut), keys, order))
                rows = rows.slice(cut)
            held, many = rows.combine_chunks().to_batches(), rows.num_rows
        if many:
            yield _row(pairs(pa.Table.from_batches(held), keys, order))

    return run


def _row(n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])
