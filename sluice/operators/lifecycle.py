"""Panes, boxes and stores over a run: closing, eviction, active rules, alerts and events as tables."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dc_rules import Group, Rule
from . import dc


def pane_states(df: DataFrame, pane_end: str, watermark_ms: int, grace_ms: int, eager: int | None = None) -> DataFrame:
    """(pane end, events, state): ``evicted`` once end + grace has passed, else ``closed`` where
    ``eager`` events are held, else ``open``. An eagerly closed pane keeps taking events."""
    panes = df.groupBy(pane_end).agg(F.count("*").alias("events"))
    state = F.when(F.col(pane_end) + grace_ms <= watermark_ms, "evicted")
    if eager is not None:
        state = state.when(F.col("events") >= eager, "closed")
    return panes.withColumn("state", state.otherwise("open"))


def evict(df: DataFrame, pane_end: str, watermark_ms: int, grace_ms: int) -> DataFrame:
    """Events of the panes that are not evicted yet."""
    return df.where(F.col(pane_end) + grace_ms > watermark_ms)


def fresh_only(df: DataFrame, key: str, ts: str, stale_seconds: float, tie: str) -> DataFrame:
    """Rows since the last silence of over ``stale_seconds`` of their key: what state survives a stale reset."""
    by = Window.partitionBy(key)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(by.orderBy(ts, tie))
    marked = df.withColumn("_run", F.sum(F.coalesce((gap > int(stale_seconds * 1_000_000)).cast("int"), F.lit(0))).over(by.orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("_last", F.max("_run").over(by)).where("_run = _last").drop("_run", "_last")


def static_bounds(groups: list[Group], bounds: dict[str, tuple[float, float]]) -> dict[int, dict[str, tuple[float, float]]]:
    """Bounds of each group's ordered columns; a column without bounds has none."""
    return {i: {d: bounds[d] for d in g.dims if d in bounds} for i, g in enumerate(groups)}


def active_boxes(state: DataFrame, groups: list[Group], bounds: dict[str, tuple[float, float]], k: float, delta_min: float, delta_max: float, warmup: int) -> DataFrame:
    """(group_id, feature, lo, hi) of the columns that have bounds; ``state`` holds feature, variance, n."""
    spark = state.sparkSession
    rows = [(i, c, float(lo), float(hi)) for i, b in static_bounds(groups, bounds).items() for c, (lo, hi) in b.items()]
    boxes = spark.createDataFrame(rows, "group_id int, feature string, low double, high double")
    # as many rows as the rules have columns
    joined = F.broadcast(boxes).join(state, "feature", "left") if state.isStreaming else boxes.join(state, "feature", "left")
    wide = F.least(F.greatest(F.sqrt("variance") * k, F.lit(delta_min)), F.lit(delta_max))
    delta = F.when(F.coalesce(F.col("n"), F.lit(0)) >= warmup, wide).otherwise(F.lit(delta_min))
    return joined.select("group_id", "feature", (F.col("low") - delta).alias("lo"), (F.col("high") + delta).alias("hi"))


def single_index(df: DataFrame, rule: Rule, id_col: str) -> DataFrame:
    """Pairs by one index, the first same-column equality; the other predicates verify."""
    first = next((p for p in rule.predicates if p.key and p.same), None)
    if first is None:
        raise ValueError("single-index mode needs an equality of one column")
    rest = tuple(p for p in rule.predicates if p is not first)
    return dc._pairs(df, df, Rule((first, *rest), rule.name), id_col)


def ids_below(df: DataFrame, col: str, id_col: str, queries: DataFrame, query_col: str, inclusive: bool = False) -> DataFrame:
    """(query, n): how many rows lie below each query value (or at it too): a running count, no pair list."""
    both = df.select(F.col(col).alias("v"), F.lit(1).alias("n"), F.lit(None).cast(queries.schema[query_col].dataType).alias("q"))
    both = both.where("v is not null").unionByName(queries.select(F.col(query_col).alias("v"), F.lit(0).alias("n"), F.col(query_col).alias("q")))
    freq = both.groupBy("v").agg(F.sum("n").alias("n"), F.max("q").alias("q"))
    proxy = dc._proxy(freq, "v")
    freq = freq.withColumn("_b", dc._bucket(proxy, dc._splits(freq, proxy)))
    sizes = freq.groupBy("_b").agg(F.sum("n").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    run = F.sum("n").over(Window.partitionBy("_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - (F.lit(0) if inclusive else F.col("n"))
    counted = freq.withColumn("_run", run).join(F.broadcast(before), "_b").where("q is not null")
    return counted.select(F.col("q").alias(query_col), (F.col("_run") + F.col("_before")).alias("n"))


class AlertStore:
    """Alerts as a table: add (an id is kept once), update, remove, and lookups by rule, window and event."""

    def __init__(self, alerts: DataFrame):
        self.alerts = alerts

    def add(self, new: DataFrame) -> "AlertStore":
        return AlertStore(self.alerts.unionByName(new.join(self.alerts.select("alert_id"), "alert_id", "left_anti")))

    def update(self, changed: DataFrame) -> "AlertStore":
        """Rows of ``changed`` replace those of their id."""
        return AlertStore(self.alerts.join(changed.select("alert_id"), "alert_id", "left_anti").unionByName(changed.select(*self.alerts.columns)))

    def remove(self, ids: DataFrame) -> "AlertStore":
        return AlertStore(self.alerts.join(ids.select("alert_id").distinct(), "alert_id", "left_anti"))

    def of_rule(self, dc_id: str) -> DataFrame:
        return self.alerts.where(F.col("dc_id") == dc_id)

    def of_window(self, window_id: str) -> DataFrame:
        return self.alerts.where(F.col("window_id") == window_id)

    def counts(self) -> DataFrame:
        """(dc_id, status, n)."""
        return self.alerts.groupBy("dc_id", "status").agg(F.count("*").alias("n"))


def event_lookup(events: DataFrame, wanted: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """The wanted events with their pane and window."""
    return events.join(wanted.select(id_col).distinct(), id_col, "left_semi").select(id_col, *columns)


def on_alert(windows: DataFrame, order: str, message: str, act: Callable[[str], None] | None = None) -> int:
    """Calls ``act`` with each alerting window's message in order, or raises the first as a ValueError.

    Windows are read one partition at a time; returns how many there were."""
    n = 0
    for row in windows.where("alert").select(order, message).orderBy(order).toLocalIterator():
        if act is None:
            raise ValueError(row[message])
        act(row[message])
        n += 1
    return n


def union_logs(*logs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def numeric_columns(df: DataFrame, leave_out: tuple[str, ...] = ()) -> list[str]:
    """Columns that a detector can score."""
    from pyspark.sql.types import BooleanType, NumericType

    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType) and f.name not in leave_out]


class Detector(ABC):
    """An anomaly detector over a table of windows: adds ``score`` and ``severity``."""

    @abstractmethod
    def score(self, windows: DataFrame) -> DataFrame: ...


class ZScoreDetector(Detector):
    """Rolling z-scores of the numeric columns, or of ``measures``."""

    def __init__(self, order: str, key: str, measures: list[str] | None = None, **options):
        self.order, self.key, self.measures, self.options = order, key, measures, options

    def score(self, windows: DataFrame) -> DataFrame:
        from .streams import rolling_scores

        found = self.measures or numeric_columns(windows, (self.key,))
        return rolling_scores(windows, self.order, found, key=self.key, **self.options)


class Accumulator(ABC):
    """A reducer of one's own: rows to an array, folded by a Column expression (update), then finished."""

    @abstractmethod
    def zero(self) -> Column: ...

    @abstractmethod
    def update(self, state: Column, value: Column) -> Column: ...

    def result(self, state: Column) -> Column:
        return state

    def over(self, c: str, order: str | None = None) -> Column:
        """The aggregate; a group's values are one array, in order of ``order`` where given."""
        rows = F.array_sort(F.collect_list(F.struct(F.col(order) if order else F.lit(0), F.col(c).alias("_x"))))
        return self.result(F.aggregate(rows, self.zero(), lambda s, r: self.update(s, r["_x"])))


def variant(df: DataFrame, rules: list[Rule], id_col: str, name: str) -> DataFrame:
    """(dc_id, s_id, t_id) by a variant of the engine: ``nl_stream`` joins without an index,
    ``single_tree`` by one index a rule, ``full`` shares one join among rules of equal keys."""
    if name == "full":
        return dc.shared_violations(df, rules, id_col)
    one = {"single_tree": lambda r: single_index(df, r, id_col), "nl_stream": lambda r: dc.violations(df, r, id_col)}[name]
    return reduce(lambda a, b: a.unionByName(b), [one(r).select(F.lit(r.name).alias("dc_id"), "s_id", "t_id") for r in rules])
