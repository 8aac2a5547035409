"""Windowed monitoring: window x instance -> measures -> assessments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Order
from pyspark.sql import functions as F

from ..functions.assess import assess
from ..functions.measures import Staged, null_safe


@dataclass(frozen=True)
class Window:
    """tumbling(duration), sliding(duration, hop) or session(gap); durations as interval texts."""

    kind: str
    duration: str
    hop: str | None = None
    origin: str = "0 seconds"

    def column(self, ts: Column) -> Column:
        if self.kind == "session":
            return F.session_window(ts, self.duration)
        return F.window(ts, self.duration, self.hop or self.duration, self.origin)


def tumbling(duration: str, origin: str = "0 seconds") -> Window:
    return Window("tumbling", duration, None, origin)


def sliding(duration: str, hop: str, origin: str = "0 seconds") -> Window:
    return Window("sliding", duration, hop, origin)


def session(gap: str) -> Window:
    return Window("session", gap)


@dataclass
class Monitor:
    """Declares checks; ``run`` plans them for a static table, ``stream`` for a stream.

    All plain measures of a task are one aggregation. Staged measures add one
    aggregation each and meet it on (window, instance), of which there are few.
    """

    time_column: str
    window: Window
    instance: str | None = None
    wait_for_late: str = "0 seconds"
    name: str = "task"
    critical: bool = False
    checks: dict[str, tuple[Column | Staged, Callable | None]] = field(default_factory=dict)

    def check(self, measure: Column | Staged, must_be=None, name: str | None = None) -> "Monitor":
        name = name or f"Unnamed_check_{len(self.checks) + 1}"
        if name in self.checks:
            raise ValueError(f"check {name!r} exists")
        self.checks[name] = (measure, assess(must_be) if must_be is not None else None)
        return self

    add = check

    @property
    def keys(self) -> list[str]:
        return ["window_start", "window_end", *([self.instance] if self.instance else [])]

    def _windowed(self, df: DataFrame) -> DataFrame:
        ts = F.col(self.time_column).cast("timestamp")
        if self.window.kind == "session":
            return self._sessions(df.where(ts.isNotNull()), ts)
        out = df.withColumn("_w", self.window.column(ts))
        return out.withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")

    def _sessions(self, df: DataFrame, ts: Column) -> DataFrame:
        """Each row with its session's bounds: a session ends where no row follows within the gap."""
        gap = F.expr(f"INTERVAL {self.window.duration}")
        by = Order.partitionBy(self.instance if self.instance else F.lit(0))
        new = F.coalesce(ts > F.lag(ts).over(by.orderBy(ts)) + gap, F.lit(True)).cast("int")
        out = df.withColumn("_new", new).withColumn("_s", F.sum("_new").over(by.orderBy(ts)))
        same = Order.partitionBy(self.instance if self.instance else F.lit(0), "_s")
        return out.withColumns({"window_start": F.min(ts).over(same), "window_end": F.max(ts).over(same) + gap}).drop("_new", "_s")

    def _plain(self, df: DataFrame) -> DataFrame:
        aggs = [m.alias(n) for n, (m, _) in self.checks.items() if not isinstance(m, Staged)] or [F.count("*").alias("_rows")]
        if self.window.kind == "session":
            w = F.session_window(F.col(self.time_column).cast("timestamp"), self.window.duration)
            got = df.groupBy(w.alias("_w"), *([self.instance] if self.instance else [])).agg(*aggs)
            return got.withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")
        return self._windowed(df).groupBy(*self.keys).agg(*aggs)

    def _assessed(self, got: DataFrame) -> DataFrame:
        cols = [F.col(k) for k in self.keys]
        for n, (_, test) in self.checks.items():
            cols.append(F.col(n))
            if test is not None:
                cols.append(F.coalesce(test(F.col(n)), F.lit(False)).alias(f"{n}_ok"))
        return got.select(*cols)

    def run(self, df: DataFrame) -> DataFrame:
        got = self._plain(df)
        for n, (m, _) in self.checks.items():
            if isinstance(m, Staged):
                part = m.plan(self._windowed(df), self.keys).withColumnRenamed("value", n)
                got = null_safe(got, part, self.keys, "left")
        return self._assessed(got)

    def stream(self, df: DataFrame) -> DataFrame:
        """One result per window once the watermark passes its end (append mode)."""
        if any(isinstance(m, Staged) for m, _ in self.checks.values()):
            raise ValueError("staged measures cannot run on a stream; use foreachBatch over closed windows")
        ts = F.col(self.time_column).cast("timestamp")
        return self._assessed(self._plain(df.withColumn(self.time_column, ts).withWatermark(self.time_column, self.wait_for_late)))


class TaskRegistry:
    """Named monitors over their own sources; a critical one's failure stops all."""

    def __init__(self):
        self.tasks: dict[str, tuple[Monitor, DataFrame]] = {}

    def new(self, monitor: Monitor, source: DataFrame, name: str | None = None) -> Monitor:
        name = name or next(f"task_{i}" for i in range(1, len(self.tasks) + 2) if f"task_{i}" not in self.tasks)
        if name in self.tasks:
            raise ValueError(f"task {name!r} exists")
        monitor.name = name
        self.tasks[name] = (monitor, source)
        return monitor

    def get(self, name: str) -> Monitor:
        return self.tasks[name][0]

    def names(self) -> list[str]:
        return list(self.tasks)

    def remove(self, name: str) -> None:
        del self.tasks[name]

    def watch_out(self, sink: Callable[[str, DataFrame], None]) -> dict[str, str]:
        """Run every task into ``sink``; returns the status of each."""
        status = {}
        for name, (monitor, source) in self.tasks.items():
            try:
                sink(name, monitor.stream(source) if source.isStreaming else monitor.run(source))
                status[name] = "ok"
            except Exception as e:
                status[name] = f"failed: {e}"
                if monitor.critical:
                    raise
        return status
