"""The rules on live streams: monitor, constraint join, incremental checks, elastic state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import millis
from ..operators import dc
from ..operators.monitor import Monitor
from ..plans.dc_rules import Rule


def monitor(m: Monitor, stream: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, name: str | None = None):
    """Start a task: one row per window and instance once the watermark passes the window."""
    w = m.stream(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint).queryName(name or m.name)
    return (w.format(sink) if isinstance(sink, str) else w.foreachBatch(sink)).trigger(availableNow=True).start()


def constraint_pairs(stream: DataFrame, rule: Rule, id_col: str, time_col: str, seconds: int, wait: str = "300 seconds") -> DataFrame:
    """Stream-stream self join; the time bound lets state be evicted by the watermark."""
    ts = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, wait)
    used = sorted({id_col, time_col} | {c for p in rule.predicates for c in (p.left, p.right) if c})
    s = ts.select(*(F.col(c).alias(f"s_{c}") for c in used))
    t = ts.select(*(F.col(c).alias(f"t_{c}") for c in used))
    gap = F.col(f"s_{time_col}").between(F.col(f"t_{time_col}"), F.col(f"t_{time_col}") + F.expr(f"INTERVAL {seconds} SECONDS"))
    on = gap & (F.col(f"s_{id_col}") != F.col(f"t_{id_col}"))
    from ..plans.dc_rules import compare

    for p in rule.predicates:
        on = on & compare(p.op, F.col(f"s_{p.left}"), F.lit(p.constant) if p.constant is not None else F.col(f"t_{p.right}"))
    return s.join(t, on).select(F.col(f"s_{id_col}").alias("s_id"), F.col(f"t_{id_col}").alias("t_id"), F.col(f"s_{time_col}").alias(time_col))


def incremental(stream: DataFrame, rule: Rule, id_col: str, history: str, pairs: str, checkpoint: str):
    """Each micro-batch is joined with the stored history both ways, then becomes history.

    Batches are written under their number, so a batch that is repeated after a
    failure replaces its own files."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            old = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(history) if number and _exists(spark, history) else batch.limit(0)
            dc.insert(old, batch, rule, id_col).write.mode("overwrite").parquet(f"{pairs}/b{number}")
            batch.write.mode("overwrite").parquet(f"{history}/b{number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ema_stream(stream: DataFrame, key: str, ts: str, value: str, alpha: float, tie: str) -> DataFrame:
    """Running mean, variance and count per key; a batch's rows are folded in order of time."""
    import pandas as pd

    def fold(k, batches: Iterator[pd.DataFrame], state):
        mean, var, n = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(batches)).dropna(subset=[value]).sort_values([ts, tie])
        for x in rows[value]:
            var = (1 - alpha) * var + alpha * (x - mean) ** 2
            mean = alpha * x + (1 - alpha) * mean
            n += 1
        state.update((mean, var, n))
        yield pd.DataFrame({key: [k[0]], "mean": [mean], "variance": [var], "n": [n]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, mean double, variance double, n long", "mean double, variance double, n long", "update", "NoTimeout")


def split_late_batches(stream: DataFrame, ts: str, wait_seconds: float, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], checkpoint: str, watermark_path: str):
    """Route each micro-batch's rows behind the stored watermark to ``late``, the others to ``on_time``."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = None
        if number and _exists(spark, watermark_path):
            seen = spark.read.option("recursiveFileLookup", "true").parquet(watermark_path).where(F.col("batch") < number).agg(F.max("wm")).first()[0]
        t = millis(F.col(ts))
        behind = t < (seen or -(1 << 62)) - int(wait_seconds * 1000)
        late(batch.where(behind), number)
        on_time(batch.where(~behind), number)
        batch.agg(F.max(t).alias("wm")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{watermark_path}/b{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
