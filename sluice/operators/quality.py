"""Per-record rules, meta stream, schema validation, run metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """kind: null, type, range or regex; anything else, or a type check without a type, is skipped."""

    name: str
    kind: str
    column: str
    type: str | None = None
    low: float | None = None
    high: float | None = None
    pattern: str | None = None

    def failed(self) -> Column | None:
        c = F.col(self.column)
        if self.kind == "null":
            return c.isNull()
        if self.kind == "type" and self.type:
            return c.isNotNull() & c.cast("string").try_cast(self.type).isNull()
        if self.kind == "range":
            low = F.coalesce(c < self.low, F.lit(False)) if self.low is not None else F.lit(False)
            high = F.coalesce(c > self.high, F.lit(False)) if self.high is not None else F.lit(False)
            return low | high
        if self.kind == "regex" and self.pattern is not None:
            return F.coalesce(~c.cast("string").rlike(f"^(?:{self.pattern})"), F.lit(False))
        return None

    def result(self) -> Column:
        bad = self.failed()
        return F.lit("skip") if bad is None else F.when(bad, "fail").otherwise("pass")


def check_records(df: DataFrame, checks: list[Check]) -> DataFrame:
    """A pass/fail/skip column per rule."""
    return df.withColumns({c.name: c.result() for c in checks})


def meta_stream(df: DataFrame, checks: list[Check], keys: list[str]) -> DataFrame:
    """Per group: checks made, passed, failed, pass rate, and failures per rule."""
    real = [c for c in checks if c.failed() is not None]
    fails = [F.count_if(c.failed()).alias(f"fail_{c.name}") for c in real]
    got = df.groupBy(*keys).agg(F.count("*").alias("events"), *fails)
    failed = sum((F.col(f"fail_{c.name}") for c in real), F.lit(0))
    total = F.col("events") * len(checks)
    return got.withColumns({"total": total, "failed": failed, "passed": total - failed, "pass_rate": F.round(1 - failed / F.greatest(total, F.lit(1)), 6)})


@dataclass(frozen=True)
class Field:
    """Constraints of a column; ``optional`` admits null."""

    name: str
    type: str
    optional: bool = False
    ge: float | None = None
    gt: float | None = None
    le: float | None = None
    lt: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None

    def errors(self) -> list[Column]:
        c = F.col(self.name)
        say = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{self.name} -> {text}"))
        out = [] if self.optional else [say(c.isNull(), "is required")]
        out.append(say(c.isNotNull() & c.cast("string").try_cast(self.type).isNull(), f"is no {self.type}"))
        for op, bound, test in (("ge", self.ge, lambda b: c < b), ("gt", self.gt, lambda b: c <= b), ("le", self.le, lambda b: c > b), ("lt", self.lt, lambda b: c >= b)):
            if bound is not None:
                out.append(say(test(bound), f"violates {op} {bound:g}"))
        if self.min_length is not None:
            out.append(say(F.length(c) < self.min_length, f"is shorter than {self.min_length}"))
        if self.max_length is not None:
            out.append(say(F.length(c) > self.max_length, f"is longer than {self.max_length}"))
        if self.pattern is not None:
            out.append(say(~c.rlike(self.pattern), "does not match"))
        return out


def fields_of(model) -> list[Field]:
    """Fields of a Pydantic-style model class: annotations and common constraints."""
    names = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    out = []
    for name, info in model.model_fields.items():
        args = getattr(info.annotation, "__args__", None)
        base = next((a for a in args if a is not type(None)), str) if args else info.annotation
        bounds = {k: getattr(m, k) for m in info.metadata for k in ("ge", "gt", "le", "lt", "min_length", "max_length", "pattern") if getattr(m, k, None) is not None}
        out.append(Field(name, names.get(base, "string"), optional=not info.is_required() or bool(args and type(None) in args), **bounds))
    return out


def validate(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Adds ``_ok`` and ``_message`` (``<n> errors: a; b``, empty when compliant)."""
    errors = F.array_compact(F.array(*(e for f in fields for e in f.errors())))
    n = F.size("_errors")
    out = df.withColumn("_errors", errors)
    text = F.when(n > 0, F.concat(n.cast("string"), F.lit(" errors: "), F.concat_ws("; ", "_errors"))).otherwise("")
    return out.withColumns({"_ok": n == 0, "_message": text}).drop("_errors")


def deflect(validated: DataFrame) -> DataFrame:
    return validated.where(~F.col("_ok"))


def keep_compliant(validated: DataFrame) -> DataFrame:
    return validated.where("_ok").drop("_ok", "_message")


def first_k_alerts(windows: DataFrame, order: str, errors: str, k: int) -> DataFrame:
    """``alert``: the window has errors and is among the first k of its run; a clean window starts a new run.

    One window function over the windows' meta rows (one row per window, so few)."""
    w = Window.orderBy(order)
    run = F.sum((F.col(errors) == 0).cast("int")).over(w)
    nth = F.sum((F.col(errors) > 0).cast("int")).over(Window.partitionBy("_run").orderBy(order))
    return windows.withColumn("_run", run).withColumn("alert", (F.col(errors) > 0) & (nth <= k)).drop("_run")


def alert_mode(windows: DataFrame, order: str, errors: str, mode: str = "persistent", k: int = 1, condition: Column | None = None) -> DataFrame:
    if mode == "persistent":
        return windows.withColumn("alert", F.col(errors) > 0)
    if mode == "only_on_first_k":
        return first_k_alerts(windows, order, errors, k)
    if mode == "only_if":
        return windows.withColumn("alert", (F.col(errors) > 0) & condition)
    raise ValueError(f"unknown alert mode {mode!r}")


def accuracy(truth: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 (4 digits) of distinct ids."""
    a, b = truth.select(id_col).distinct().withColumn("_t", F.lit(1)), found.select(id_col).distinct().withColumn("_d", F.lit(1))
    n = a.join(b, id_col, "full").agg(F.count_if(F.col("_t").isNotNull() & F.col("_d").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_d").isNull()).alias("fn"))
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(share(2 * p * r, p + r), 4).alias("f1"))


def nearest_rank(df: DataFrame, col: str, points: list[float], keys: list[str]) -> DataFrame:
    """Percentiles ``sorted[int(n p)]`` by counting ranks over value frequencies."""
    freq = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(col)
    run = freq.withColumns({"_to": F.sum("_n").over(w), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    pick = lambda p: F.least(F.floor(F.col("_all") * p), F.col("_all") - 1)
    return run.groupBy(*keys).agg(*(F.min(F.when(F.col("_to") > pick(p), F.col(col))).alias(f"p{round(p * 100)}") for p in points))


def run_summary(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(col), 4).alias("mean"), F.round(F.stddev_samp(col), 4).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
