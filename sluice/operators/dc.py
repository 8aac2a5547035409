"""Checks of denial constraints: counts, existence, pairs, increments.

A count is the number of ordered pairs of different rows; a row is no pair with itself,
whatever its id. No count lists pairs: rows become points with weights (how many rows
stand there as s, how many as t), equalities are the key, ``<>`` is all less equal, and
each inequality but one is a tree over the ranks of its values, in which two rows of
different rank part at exactly one node; the last inequality is a running count within
the nodes. Cost is n log n for each tree, at every size and for every ordered type.
With equalities and several inequalities, rows are dealt by the key once and the trees of
groups that fit are built in memory; only larger groups are copied to tree nodes.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..deploy import ship
from ..plans.dc_rules import Predicate, Rule, compare
from . import dominance

#: ranges that values are split into before they are ordered.
BUCKETS = 64
#: hash cells whose sizes bound those of the groups in them.
CELLS = 1 << 16


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def violations(df: DataFrame, rule: Rule, id_col: str) -> DataFrame:
    """(s_id, t_id) of all ordered pairs of different ids that break the rule: an equi-join with the rest as residual."""
    return _pairs(df, df, rule, id_col)


def _pairs(left: DataFrame, right: DataFrame, rule: Rule, id_col: str, flags: list[Rule] | None = None) -> DataFrame:
    used = {id_col} | {c for r in [rule, *(flags or [])] for p in r.predicates for c in (p.left, p.right) if c}
    s, t = left.select(*sorted(used & set(left.columns))).alias("s"), right.select(*sorted(used & set(right.columns))).alias("t")
    on = [F.col(f"s.{p.left}") == F.col(f"t.{p.right}") for p in rule.keys]
    on += [p.column() for p in rule.rest]
    if flags:
        on.append(reduce(lambda a, b: a | b, (r.column() for r in flags)))
    on.append(F.col(f"s.{id_col}") != F.col(f"t.{id_col}"))
    joined = s.join(t, _all(on))
    cols = [F.col(f"s.{id_col}").alias("s_id"), F.col(f"t.{id_col}").alias("t_id")]
    return joined.select(*cols, *(r.column().alias(r.name) for r in flags or []))


def shared_violations(df: DataFrame, rules: list[Rule], id_col: str) -> DataFrame:
    """(dc_id, s_id, t_id): rules with one equality signature share one join, a flag per rule."""
    out = None
    for sig in dict.fromkeys(r.signature for r in rules):
        group = [r for r in rules if r.signature == sig]
        flagged = _pairs(df, df, Rule(tuple(group[0].keys)), id_col, group)
        names = F.array_compact(F.array(*(F.when(F.col(r.name), F.lit(r.name)) for r in group)))
        one = flagged.select(F.explode(names).alias("dc_id"), "s_id", "t_id")
        out = one if out is None else out.unionByName(one)
    return out


def counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(dc_id, violations) of each rule."""
    parts = [count(df, r).select(F.lit(r.name).alias("dc_id"), "violations") for r in rules]
    return reduce(lambda a, b: a.unionByName(b), parts)


def exists(df: DataFrame, rule: Rule) -> DataFrame:
    """One row, column ``violated``. One homogeneous inequality needs only the extremes of each key."""
    order = rule.order
    if len(order) == 1 and len(rule.predicates) == len(rule.keys) + 1 and order[0].same and all(k.same for k in rule.keys):
        c = order[0].left
        known = df.dropna(subset=[c, *(k.left for k in rule.keys)])
        per = known.groupBy(*(k.left for k in rule.keys)).agg(F.max(c).alias("hi"), F.min(c).alias("lo"), F.count("*").alias("n"))
        broken = F.col("hi") > F.col("lo") if order[0].op in ("<", ">") else F.col("n") > 1
        return per.agg(F.coalesce(F.bool_or(broken), F.lit(False)).alias("violated"))
    return count(df, rule).select((F.col("violations") > 0).alias("violated"))


def _proxy(df: DataFrame, col: str) -> Column:
    """A number that never falls as the value rises: ranges are cut by it."""
    kind, c = df.schema[col].dataType, F.col(col)
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.substring(F.hex(F.encode(c, "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("double")
    return F.lit(0.0)


def _splits(df: DataFrame, proxy: Column) -> list[float]:
    got = df.agg(F.percentile_approx(proxy, [i / BUCKETS for i in range(1, BUCKETS)], 2000)).first()[0]
    return sorted(set(got or []))


def _bucket(proxy: Column, splits: list[float]) -> Column:
    """Number of splits below the value: equal values share a bucket, order is kept."""
    return F.size(F.filter(F.array(*(F.lit(x) for x in splits)), lambda x: x < proxy)) if splits else F.lit(0)


def _ordered_count(rows: DataFrame, keys: list[str], dim: str, op: str) -> DataFrame:
    """``n``: sum of cl(v) * cr(v') over the pairs with v op v' within a key; rows hold the keys, v, cl, cr."""
    proxy = _proxy(rows, dim)
    down = op in ("<", "<=")
    way = (lambda c: F.col(c).desc()) if down else (lambda c: F.col(c).asc())
    freq = rows.withColumn("_b", _bucket(proxy, _splits(rows, proxy)))
    total = freq.groupBy(*keys, "_b").agg(F.sum("cr").alias("_r"))
    below = total.withColumn("_below", F.sum("_r").over(Window.partitionBy(*keys).orderBy(way("_b"))) - F.col("_r")).drop("_r")
    run = F.sum("cr").over(Window.partitionBy(*keys, "_b").orderBy(way(dim)).rowsBetween(Window.unboundedPreceding, 0))
    counted = freq.withColumn("_run", run - (F.col("cr") if op in ("<", ">") else F.lit(0)))
    product = F.col("cl").cast("decimal(19,0)") * (F.col("_run") + F.col("_below")).cast("decimal(19,0)")
    return counted.join(below, [*keys, "_b"]).agg(F.sum(product).cast("decimal(38,0)").alias("n"))


def _ranks(rows: DataFrame, dim: str) -> DataFrame:
    """(dim, _rank): positions of the distinct values in their order, from 0; ordered range by range."""
    values = rows.select(dim).distinct()
    proxy = _proxy(values, dim)
    values = values.withColumn("_b", _bucket(proxy, _splits(values, proxy)))
    sizes = values.groupBy("_b").agg(F.count("*").alias("_n"))
    # as many rows as there are ranges
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).drop("_n")
    place = values.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(dim)))
    return place.join(F.broadcast(before), "_b").select(dim, (F.col("_before") + F.col("_i") - 1).alias("_rank"))


def _parted(rows: DataFrame, keys: list[str], dim: str, op: str, distinct: int, others: list[str]) -> DataFrame | None:
    """Rows at the nodes of a tree over the ranks of ``dim``, where a pair that satisfies ``op`` meets once.

    At level l rows of equal rank >> (l + 1) meet, the higher half as one side and the
    lower as the other; for the loose operators equal ranks meet at a level of their own.
    """
    bits = (distinct - 1).bit_length()
    high = 1 if op in (">", ">=") else 0
    ranked = rows.join(_ranks(rows, dim), dim)
    bit = lambda i: F.expr(f"shiftright(_rank, {i}) & 1")
    at = [F.struct(F.lit(i).alias("l"), F.expr(f"shiftright(_rank, {i + 1})").alias("x"), F.when(bit(i) == high, F.col("cl")).otherwise(0).alias("cl"), F.when(bit(i) == high, 0).otherwise(F.col("cr")).alias("cr")) for i in range(bits)]
    if op in (">=", "<="):
        at.append(F.struct(F.lit(-1).alias("l"), F.col("_rank").alias("x"), F.col("cl").alias("cl"), F.col("cr").alias("cr")))
    if not at:
        return None
    node = ranked.select(*keys, *others, F.explode(F.array(*at)).alias("_at"))
    level, place = f"_l_{dim}", f"_x_{dim}"
    node = node.select(*keys, *others, F.col("_at.l").alias(level), F.col("_at.x").alias(place), F.col("_at.cl").alias("cl"), F.col("_at.cr").alias("cr")).where("cl > 0 or cr > 0")
    return node.groupBy(*keys, level, place, *others).agg(F.sum("cl").alias("cl"), F.sum("cr").alias("cr"))


def _total(rows: DataFrame, keys: list[str], order: list[tuple[str, str]]) -> DataFrame | None:
    """``n``: pairs (a row as s, a row as t) of a key that satisfy every (column, operator)."""
    dims = [d for d, _ in order]
    rows = rows.groupBy(*keys, *dims).agg(F.sum("cl").alias("cl"), F.sum("cr").alias("cr"))
    if not order:
        return rows.agg(F.sum(F.col("cl").cast("decimal(19,0)") * F.col("cr").cast("decimal(19,0)")).cast("decimal(38,0)").alias("n"))
    if len(order) > 1:  # trees over the columns of fewest values
        distinct = rows.agg(*(F.count_distinct(d).alias(d) for d in dims)).first()
        order = sorted(order, key=lambda x: distinct[x[0]])
        for i, (dim, op) in enumerate(order[:-1]):
            rows = _parted(rows, keys, dim, op, distinct[dim], [d for d, _ in order[i + 1 :]])
            if rows is None:
                return None
            keys = [*keys, f"_l_{dim}", f"_x_{dim}"]
    return _ordered_count(rows, keys, *order[-1])


def _crowded(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys of over ``dominance.CHUNK`` rows, None if there are none: looked for only if a cell of hashes has so many."""
    n = F.count("*").alias("_n")
    most = rows.groupBy(F.pmod(F.xxhash64(*keys), F.lit(CELLS)).alias("_c")).agg(n).agg(F.max("_n")).first()[0]
    if (most or 0) <= dominance.CHUNK:
        return None
    found = rows.groupBy(*keys).agg(n).where(F.col("_n") > dominance.CHUNK).select(*keys)
    return None if found.isEmpty() else found


def _grouped(rows: DataFrame, keys: list[str], order: list[tuple[str, str, str]]) -> DataFrame:
    """``n``: pairs of a key that satisfy every (left, right, operator), each group in a task's memory."""
    ship(rows.sparkSession)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(dominance.counter(keys, order), "n long").agg(F.sum(F.col("n").cast("decimal(19,0)")).cast("decimal(38,0)").alias("n"))


def _plain(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)) or kind == T.StringType()


def _counts(df: DataFrame, pairs: list[Predicate], keys: list[Predicate], order: list[Predicate], fixed: list[Column]) -> list[DataFrame]:
    """``n`` of each part: pairs that agree in the keys and satisfy ``order``, of rows known in all of ``pairs``."""
    known = lambda side: _all(F.col(getattr(p, side)).isNotNull() for p in pairs)
    kinds = [(df.schema[p.left].dataType, df.schema[p.right].dataType) for p in [*keys, *order]]
    # -0.0 equals 0.0, so one key must not be dealt to two tasks
    key = lambda c: (F.col(c) + F.lit(0.0).cast(df.schema[c].dataType)) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c)
    names, dims = [f"k{i}" for i in range(len(keys))], [(f"d{i}", p.op) for i, p in enumerate(order)]
    sided = lambda side: [*(key(getattr(p, side)).alias(n) for p, n in zip(keys, names)), *(F.col(getattr(p, side)).alias(d) for p, (d, _) in zip(order, dims))]
    left = df.where(_all(fixed) & known("left")).select(*sided("left"), F.lit(1).alias("cl"), F.lit(0).alias("cr"))
    right = df.where(known("right")).select(*sided("right"), F.lit(0).alias("cl"), F.lit(1).alias("cr"))
    rows, parts = left.union(right), []
    if len(order) > 1 and keys and all(_plain(k) for two in kinds for k in two):
        if all(p.same for p in keys) and all(a == b for a, b in kinds):  # one row is both s and t
            at = {c: f"v{i}" for i, c in enumerate(dict.fromkeys(c for p in order for c in (p.left, p.right)))}
            side = F.coalesce((_all(fixed) & known("left")).cast("int"), F.lit(0)) + 2 * known("right").cast("int")
            points = df.select(*sided("left")[: len(keys)], *(F.col(c).alias(n) for c, n in at.items()), side.alias("_side")).where("_side > 0")
            three = [(at[p.left], at[p.right], p.op) for p in order]
        else:
            points = rows.select(*names, *(d for d, _ in dims), (F.col("cl") + 2 * F.col("cr")).alias("_side"))
            three = [(d, d, op) for d, op in dims]
        crowded = _crowded(points, names)
        if crowded is None:
            return [_grouped(points, names, three)]
        parts.append(_grouped(points.join(crowded, names, "left_anti"), names, three))
        rows = rows.join(crowded, names, "left_semi")
    rest = _total(rows, names, dims)
    return parts if rest is None else [*parts, rest]


def count(df: DataFrame, rule: Rule) -> DataFrame:
    """One row, column ``violations``: ordered pairs of different rows that break the rule.

    A null in a column of a predicate makes it not hold. Columns compared may differ;
    constants are a filter on s; rows are told apart even where all their values agree.
    """
    pairs = [p for p in rule.predicates if p.constant is None]
    fixed = [compare(p.op, F.col(p.left), F.lit(p.constant)) for p in rule.predicates if p.constant is not None]
    unequal = [p for p in pairs if p.op == "<>"]
    own = df.agg(F.count_if(_all([compare(p.op, F.col(p.left), F.col(p.right)) for p in pairs] + fixed)).cast("decimal(38,0)").alias("n"))
    out = own.select((-F.col("n")).alias("n"))
    # pairs with x <> y are all pairs less those with x = y, for each such predicate
    for m in range(len(unequal) + 1):
        for equal in combinations(unequal, m):
            for part in _counts(df, pairs, [*rule.keys, *equal], rule.order, fixed):
                out = out.union(part.select((F.col("n") if m % 2 == 0 else -F.col("n")).cast("decimal(38,0)").alias("n")))
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations"))


def insert(history: DataFrame, delta: DataFrame, rule: Rule, id_col: str) -> DataFrame:
    """New pairs after an insert: the delta against the history both ways, and within itself."""
    return _pairs(delta, history, rule, id_col).union(_pairs(history, delta, rule, id_col)).union(_pairs(delta, delta, rule, id_col))


def delete(pairs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Pairs left after rows are deleted: neither end may be gone."""
    g = gone.select(F.col(id_col).alias("_gone")).distinct()
    return pairs.join(g, F.col("s_id") == F.col("_gone"), "left_anti").join(g, F.col("t_id") == F.col("_gone"), "left_anti")


def band_join(df: DataFrame, keys: list[str], col: str, eps: float, id_col: str, extra: Column | None = None) -> DataFrame:
    """Pairs of one key whose ``col`` differs by at most ``eps``: equal or neighbouring cells of that width."""
    cell = F.floor(F.col(col) / eps)
    s = df.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1))).alias("s")
    t = df.withColumn("_cell", cell).alias("t")
    on = [F.col(f"s.{k}") == F.col(f"t.{k}") for k in [*keys, "_cell"]]
    on += [F.abs(F.col(f"s.{col}") - F.col(f"t.{col}")) <= eps, F.col(f"s.{id_col}") != F.col(f"t.{id_col}")] + ([extra] if extra is not None else [])
    return s.join(t, reduce(lambda a, b: a & b, on)).select(F.col(f"s.{id_col}").alias("s_id"), F.col(f"t.{id_col}").alias("t_id"))


def windowed_pairs(df: DataFrame, rule: Rule, id_col: str, time_col: str, seconds: int) -> DataFrame:
    """Violating pairs whose later event is s, at most ``seconds`` after t. Cells of that
    length make the time bound part of the equality key, so no key's history is paired whole."""
    cell = F.floor(F.unix_micros(F.col(time_col).cast("timestamp")) / (seconds * 1_000_000))
    s, t = df.withColumn("_cell", F.explode(F.array(cell, cell - 1))).alias("s"), df.withColumn("_cell", cell).alias("t")
    gap = F.unix_micros(F.col(f"s.{time_col}").cast("timestamp")) - F.unix_micros(F.col(f"t.{time_col}").cast("timestamp"))
    on = [F.col("s._cell") == F.col("t._cell"), gap >= 0, gap <= seconds * 1_000_000, F.col(f"s.{id_col}") != F.col(f"t.{id_col}")] + [p.column() for p in rule.predicates]
    return s.join(t, reduce(lambda a, b: a & b, on)).select(F.col(f"s.{id_col}").alias("s_id"), F.col(f"t.{id_col}").alias("t_id"))


def in_box(bounds: dict[str, tuple[float, float]]) -> Column:
    """Inclusive on both ends in every dimension; a missing (null) value is outside."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(c).between(lo, hi), F.lit(False)) for c, (lo, hi) in bounds.items()), F.lit(True))


def boxes_meet(a: dict[str, tuple[Column, Column]], b: dict[str, tuple[Column, Column]]) -> Column:
    """Whether two boxes overlap, ends included; a dimension that one lacks is unbounded there."""
    return _all((a[c][0] <= b[c][1]) & (b[c][0] <= a[c][1]) for c in a if c in b)


def distance(cols: list[str], point: list, metric: str = "euclidean") -> Column:
    """Euclidean distance, or the number of coordinates that differ (``hamming``)."""
    if metric == "hamming":
        return reduce(lambda a, b: a + b, ((~F.col(c).eqNullSafe(F.lit(x))).cast("int") for c, x in zip(cols, point)))
    return F.sqrt(reduce(lambda a, b: a + b, (F.pow(F.col(c) - x, 2) for c, x in zip(cols, point))))


def within(df: DataFrame, point: list, radius: float, cols: list[str], metric: str = "euclidean") -> DataFrame:
    """Rows at most ``radius`` from the point; the box around it bounds the scan first."""
    if metric == "euclidean":
        df = df.where(in_box({c: (x - radius, x + radius) for c, x in zip(cols, point)}))
    return df.where(distance(cols, point, metric) <= radius)


def nearest(df: DataFrame, point: list[float], n: int, cols: list[str], id_col: str, accept: Column | None = None) -> DataFrame:
    """The n rows closest by Euclidean distance that ``accept`` holds for, ties by id."""
    kept = df if accept is None else df.where(accept)
    return kept.select(id_col, F.round(distance(cols, point), 6).alias("distance")).orderBy("distance", id_col).limit(n)


def edit(points: DataFrame, changes: DataFrame, id_col: str) -> DataFrame:
    """Points after inserts, moves and deletes: a change row replaces its id; null coordinates delete it."""
    rest = points.join(changes.select(id_col).distinct(), id_col, "left_anti")
    coords = [c for c in points.columns if c != id_col]
    return rest.unionByName(changes.select(*points.columns).where(_all(F.col(c).isNotNull() for c in coords)))
