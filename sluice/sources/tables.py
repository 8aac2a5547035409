"""Sources and sinks: event tables from text, compact records, artificial streams, metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import normal, parse_time, uniform

_CASTS = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}


@dataclass(frozen=True)
class EventSchema:
    """Columns of a raw event: times (with a strptime format, ISO if None), typed fields, required ones."""

    time_field: str
    time_format: str | None = None
    ingestion_field: str | None = None
    partition_key: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()


def normalise(raw: DataFrame, schema: EventSchema, id_field: str | None = None, strict: bool = False) -> DataFrame:
    """event_id, event_time, ingestion_time, partition_key, the typed fields, and ``reject`` (a reason or null).

    Blank optional fields are null. A missing id is a new uuid. ``strict`` raises on the first reject."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    when = parse_time(text(schema.time_field), schema.time_format)
    arrived = parse_time(text(schema.ingestion_field), schema.time_format) if schema.ingestion_field else F.lit(None).cast("timestamp")
    reasons = [F.when(when.isNull(), F.lit(f"{schema.time_field} is no time"))]
    reasons += [F.when(text(c).isNull(), F.lit(f"{c} is required")) for c in schema.required]
    typed = {c: text(c).try_cast(_CASTS[t]) for c, t in schema.fields.items()}
    reasons += [F.when(text(c).isNotNull() & typed[c].isNull(), F.lit(f"{c} is no {t}")) for c, t in schema.fields.items()]
    reject = F.nullif(F.concat_ws("; ", *reasons), F.lit(""))
    if strict:
        reject = F.when(reject.isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(reject).cast("string"))
    ident = F.coalesce(F.nullif(text(id_field), F.lit("NaN")), F.uuid()) if id_field else F.uuid()
    key = text(schema.partition_key) if schema.partition_key else F.lit(None).cast("string")
    return raw.select(ident.alias("event_id"), when.alias("event_time"), F.coalesce(arrived, F.current_timestamp()).alias("ingestion_time"), key.alias("partition_key"), *(c.alias(n) for n, c in typed.items()), reject.alias("reject"))


def source(spark: SparkSession, format: str, path: str | None = None, schema=None, stream: bool = False, **options) -> DataFrame:
    """Any registered format (csv, json, parquet, orc, text, kafka, jdbc, rate, ...); text formats default to all-string columns."""
    reader = (spark.readStream if stream else spark.read).format(format).options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.load(path) if path else reader.load()


def csv_events(spark: SparkSession, path: str, columns: list[str], header: bool = True, sep: str = ",", stream: bool = False) -> DataFrame:
    """All-string CSV; short rows are padded with nulls, never dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return source(spark, "csv", path, schema, stream, header=str(header).lower(), sep=sep, mode="PERMISSIVE")


def schema_from_json(types: dict[str, str]) -> T.StructType:
    """name -> float, int, bool or anything else (text)."""
    kinds = {"float": T.DoubleType(), "int": T.LongType(), "bool": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds.get(t, T.StringType())) for n, t in types.items()])


def sink(df: DataFrame, format: str, path: str | None = None, mode: str = "append", **options):
    """Write a table, or start a streaming query in append mode."""
    if df.isStreaming:
        w = df.writeStream.format(format).outputMode("append").options(**options)
        return w.start(path) if path else w.start()
    w = df.write.format(format).mode(mode).options(**options)
    return w.save(path) if path else w.save()


def compact_to_native(df: DataFrame, columns: dict[str, str], fields: str = "fields", values: str = "values", keep: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """(fields, values) arrays to typed columns, by name, so the order may change from row to row."""
    m = F.map_from_arrays(F.col(fields), F.col(values))
    return df.select(*keep, *(F.try_element_at(m, F.lit(c)).cast(t).alias(c) for c, t in columns.items()))


def with_id(df: DataFrame, col: str = "id", dense_order: list[str] | None = None) -> DataFrame:
    """Unique text id: increasing, or dense by an order where one is given."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(*dense_order)) if dense_order else F.monotonically_increasing_id()
    return df.withColumn(col, n.cast("string"))


# ---- artificial streams --------------------------------------------------------
def range_stream(spark: SparkSession, n: int, offset: int = 0) -> DataFrame:
    return spark.range(offset, offset + n).withColumnRenamed("id", "value")


def noisy_linear(spark: SparkSession, n: int, slope: float = 1.0, noise: float = 1.0, seed: int = 1) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("double").alias("x"), (F.col("id") * slope + noise * normal(seed, "id")).alias("y"))


def viewership(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Random rows of a media log; categories are picked by hash."""
    pick = lambda k, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), F.floor(uniform(seed + k, "id") * len(xs)).cast("int") + 1)
    return spark.range(n).select(
        F.col("id").cast("string").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("timestamp"),
        F.floor(uniform(seed, "id") * 1000).alias("user_id"), pick(1, "play", "pause", "stop", "seek").alias("action"),
        pick(2, "tv", "phone", "tablet", "desktop").alias("device"), pick(3, "news", "film", "sport", "music").alias("category"),
        F.floor(uniform(seed + 4, "id") * 7200).alias("seconds"), F.round(uniform(seed + 5, "id") * 5, 1).alias("rating"),
    )


def metrics_rows(spark: SparkSession, run_id: str, rows: list[tuple[int, float, int]]) -> DataFrame:
    """(run_id, tuples, seconds, violations) as a table for any sink."""
    return spark.createDataFrame([(run_id, *r) for r in rows], "run_id string, tuples long, seconds double, violations long")


def clean(df: DataFrame, positive: list[str], start: str, end: str, low: float, high: float, jitter: Column | None = None) -> DataFrame:
    """Rows whose ``positive`` columns are over 0 and whose duration is within bounds."""
    duration = F.unix_timestamp(F.col(end).cast("timestamp")) - F.unix_timestamp(F.col(start).cast("timestamp"))
    out = df.withColumn("duration", duration).where(F.col("duration").between(low, high))
    for c in positive:
        out = out.where(F.col(c) > 0)
    return out.withColumn("ingestion", F.col(end) + jitter) if jitter is not None else out


def resample_join(left: DataFrame, right: DataFrame, ts: str, value: str, key: list[str], width: str) -> DataFrame:
    """Each left row with the mean of the right rows of its key and time cell."""
    cell = lambda: F.window(F.col(ts).cast("timestamp"), width)["start"]
    means = right.withColumn("_cell", cell()).groupBy(*key, "_cell").agg(F.avg(value).alias(f"mean_{value}"))
    return left.withColumn("_cell", cell()).join(means, [*key, "_cell"], "left").drop("_cell")
