"""Reproducible error injection. Randomness is a hash of the row's key and a seed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal, uniform

TAU = 6.283185307179586


# ---- conditions ---------------------------------------------------------------
def always() -> Column: return F.lit(True)  # noqa: E704
def probability(p: float, seed: int, *keys: str) -> Column: return uniform(seed, *keys) < p  # noqa: E704
def where(test: Column) -> Column: return F.coalesce(test, F.lit(False))  # noqa: E704
def all_of(*tests: Column) -> Column: return reduce(lambda a, b: a & b, tests, F.lit(True))  # noqa: E704


def cosine_share(ts: Column, period_seconds: float, shift: float = 0.0, negative: bool = False) -> Column:
    """Probability 0.5 cos(2 pi (t + shift) / period) + 0.5, or one minus it."""
    t = F.unix_timestamp(ts.cast("timestamp")).cast("double")
    p = F.cos((t + shift) * (TAU / period_seconds)) * 0.5 + 0.5
    return 1 - p if negative else p


# ---- polluters -----------------------------------------------------------------
@dataclass(frozen=True)
class Polluter:
    """Changes columns where the condition holds; ``name`` goes to the log."""

    name: str
    change: Callable[[DataFrame], dict[str, Column]]
    condition: Column = field(default_factory=always)

    def __call__(self, df: DataFrame) -> DataFrame:
        new = self.change(df)
        return df.withColumns({c: F.when(self.condition, e.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, e in new.items()})


def replace(cols: list[str], value, condition: Column) -> Polluter:
    return Polluter("replace", lambda df: {c: F.lit(value) for c in cols}, condition)


def multiply(cols: list[str], k: float, condition: Column) -> Polluter:
    return Polluter("multiply", lambda df: {c: F.col(c) * k for c in cols}, condition)


def reduce_precision(cols: list[str], digits: int, condition: Column) -> Polluter:
    return Polluter("reduce_precision", lambda df: {c: F.bround(c, digits) for c in cols}, condition)


def gaussian(cols: list[str], mu: float, sigma: float, seed: int, keys: list[str], condition: Column) -> Polluter:
    return Polluter("gaussian", lambda df: {c: F.col(c) + mu + sigma * normal(seed + i, *keys) for i, c in enumerate(cols)}, condition)


def permute(cols: list[str], seed: int, keys: list[str], condition: Column) -> Polluter:
    """Values move by a hash-chosen rotation of 1 to n - 1 places, so none keeps its own."""
    n = len(cols)
    by = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n - 1)).cast("int") + 1
    return Polluter("permute", lambda df: {c: F.element_at(F.array(*(F.col(x) for x in cols)), F.pmod(by + i, F.lit(n)) + 1) for i, c in enumerate(cols)}, condition)


def concat_shift(sources: list[str], target: str, condition: Column, sep: str = " ") -> Polluter:
    """The non-empty sources joined into ``target``; the others become null."""
    joined = F.concat_ws(sep, *(F.when(F.col(c) != "", F.col(c)) for c in sources))
    return Polluter("concat", lambda df: {target: joined} | {c: F.lit(None) for c in sources if c != target}, condition)


def semi_empty(cols: list[str], share: float, seed: int, keys: list[str], condition: Column) -> Polluter:
    """The given share of the columns, chosen by hash per row, becomes null."""
    n = round(len(cols) * share)
    order = F.array_sort(F.array(*(F.struct(F.xxhash64(F.lit(seed), F.lit(c), *keys).alias("h"), F.lit(c).alias("c")) for c in cols)))
    chosen = F.transform(F.slice(order, 1, n), lambda x: x["c"]) if n else F.array().cast("array<string>")
    return Polluter("semi_empty", lambda df: {c: F.when(F.array_contains(chosen, c), F.lit(None)).otherwise(F.col(c)) for c in cols}, condition)


def transform(cols: list[str], fn: Callable[[Column], Column], condition: Column) -> Polluter:
    return Polluter("transform", lambda df: {c: fn(F.col(c)) for c in cols}, condition)


def composite(*polluters: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: reduce(lambda d, p: p(d), polluters, df)


def remove(condition: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.where(~condition)


def duplicate(id_col: str, condition: Column, suffix: str = "_D") -> Callable[[DataFrame], DataFrame]:
    """A copy of each matching row whose id (as text) has the suffix."""
    return lambda df: df.withColumn(id_col, F.col(id_col).cast("string")).unionByName(df.where(condition).withColumn(id_col, F.concat(F.col(id_col).cast("string"), F.lit(suffix))))


def delay(ts: str, seconds: float, condition: Column, arrival: str = "arrival") -> Callable[[DataFrame], DataFrame]:
    """Rows that match arrive ``seconds`` after their time."""
    late = F.col(ts) + F.make_dt_interval(secs=F.lit(seconds))
    return lambda df: df.withColumn(arrival, F.when(condition, late).otherwise(F.col(ts)))


def for_duration(key: str, ts: str, seconds: float, trigger: Column, polluter: Callable[[Column], Polluter], tie: str) -> Callable[[DataFrame], DataFrame]:
    """Once triggered, a key is polluted for ``seconds``; triggers within it do not extend it.

    The ends of the periods are an ordered fold over the key's trigger times."""

    def run(df: DataFrame) -> DataFrame:
        t = F.unix_micros(F.col(ts).cast("timestamp"))
        times = F.array_sort(F.collect_list(F.when(trigger, t)))
        span = int(seconds * 1_000_000)
        starts = F.aggregate(times, F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) | (x >= F.element_at(acc, -1) + span), F.array_append(acc, x)).otherwise(acc))
        per = df.groupBy(key).agg(starts.alias("_starts"))
        joined = df.join(per, key)
        on = F.exists("_starts", lambda s: (t >= s) & (t < s + span))
        return polluter(F.col("_on"))(joined.withColumn("_on", on)).drop("_on", "_starts")

    return run


def log(before: DataFrame, polluter: Polluter, id_col: str) -> DataFrame:
    """(id, polluter, attribute, old, new) for each value that the polluter changes."""
    cols = list(polluter.change(before))
    kept = before.withColumns({f"_old_{c}": F.col(c) for c in cols})
    after = polluter(kept)
    rows = F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(f"_old_{c}").cast("string").alias("old_value"), F.col(c).cast("string").alias("new_value")) for c in cols))
    out = after.select(F.col(id_col).cast("string").alias("id"), F.lit(polluter.name).alias("polluter"), F.explode(rows).alias("x"))
    return out.select("id", "polluter", "x.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


# ---- benchmark injections ---------------------------------------------------------
def sudden_drift(col: str, ts: str, hour: int, k: float) -> Polluter:
    return multiply([col], k, F.hour(F.col(ts).cast("timestamp")) == hour)


def incremental_drift(col: str, ts: str, start: str, rate: float) -> Polluter:
    """Values grow by ``rate`` per minute since ``start``."""
    t0 = F.unix_timestamp(F.lit(start).cast("timestamp"))
    minutes = (F.unix_timestamp(F.col(ts).cast("timestamp")) - t0) / 60
    return Polluter("incremental_drift", lambda df: {col: F.col(col) * (1 + minutes * rate)}, minutes >= 0)


def late_arrivals(ts: str, share: float, low: float, high: float, seed: int, keys: list[str], arrival: str = "ingestion_time") -> Callable[[DataFrame], DataFrame]:
    """A share of the rows arrives ``low`` to ``high`` seconds late."""
    extra = F.when(uniform(seed, *keys) < share, uniform(seed + 1, *keys) * (high - low) + low).otherwise(0.0)
    return lambda df: df.withColumn(arrival, F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) + (extra * 1_000_000).cast("long")))


def inject_pair_violations(df: DataFrame, key: list[str], col: str, id_col: str, ratio: float, shift: float, condition: Column) -> DataFrame:
    """Matching rows take ``ratio * (their key's median) + shift``; a truth column names the kind."""
    mid = df.groupBy(*key).agg(F.percentile(col, 0.5).alias("_mid"))
    hit = df.join(mid, key, "left")
    return hit.withColumns({col: F.when(condition, F.col("_mid") * ratio + shift).otherwise(F.col(col)), "noise_type": F.when(condition, F.lit("dc2"))}).drop("_mid")


def run_index(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(ts)))
