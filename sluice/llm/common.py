"""Shared plumbing: the cluster's shared folder, stable row ids, graph components."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fnv-style odd multipliers used by the vectorised string hashes.
MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, as the cluster names it in spark.checkpoint.dir.

    Where the setting is absent and the master is local (tests) a folder below the
    system's temporary one is used and also set as the checkpoint folder; on a cluster,
    whose executors do not share that folder, its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = getattr(context, "_sluice_shared", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", f"sluice-{uuid.uuid4().hex}")
        os.makedirs(found, exist_ok=True)
        found = "file://" + found
        context._sluice_shared = found
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/sluice/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the actions within go as soon as each one ends, not when the driver
    happens to collect its garbage. The session's own setting is put back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, tag: str, row_group: int = 128 << 20) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.
    A task holds up to ``row_group`` bytes of rows before it writes them."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", row_group).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sluice_path = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for df in dfs:
        remove_path(df.sparkSession, df._sluice_path)


#: Words of 64 bits in the filter of ``thinned``: its broadcast side has at most so many rows.
FILTER_WORDS = 1 << 20


def thinned(df: DataFrame, hash_col: str, wanted: DataFrame, wanted_col: str) -> DataFrame:
    """Rows of ``df`` whose 64-bit hash may be among the wanted ones (a one-probe bit filter).

    Spares most of a shuffle that an exact join needs afterwards. The filter has a fixed
    size, so beyond some hundred million wanted rows it merely lets more through.
    """
    word = lambda c: F.shiftrightunsigned(c, 6).bitwiseAND(FILTER_WORDS - 1)
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 AS INT))")
    bits = wanted.select(word(F.col(wanted_col)).alias("_word"), bit(wanted_col).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    out = df.withColumn("_word", word(F.col(hash_col))).join(F.broadcast(bits), "_word")
    return out.where(F.col("_bits").bitwiseAND(bit(hash_col)) != 0).drop("_word", "_bits")


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hash_sample(df: DataFrame, key, most: int, n: int | None = None) -> DataFrame:
    """At most ``most`` rows of ``df``, those with the least hashes of ``key`` columns.

    Rows are first thinned to about ``most`` in each task by a threshold on the hash, so
    that the final ordering sees a bounded number of rows however many tasks there are.
    """
    n = df.count() if n is None else n
    h = F.xxhash64(*key)
    if n > 2 * most:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 1.2 * most / n) + 1)
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), *key).limit(most)


def crc_mod(col, modulus: int):
    """crc32 of the decimal text modulo; a null id counts as the empty text (crc32 0)."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end of another."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up")).union(edges.select(F.col("b").alias("x"), F.lit(0).alias("up")))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
    with shuffles_freed(edges.sparkSession):
        return per.where("up > 1 or (up = 1 and low = 0)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the least id.

    Alternates large-star and small-star contraction. The neighbour minimum is a
    partially aggregated ``min``, stored before the join, so that both sides of the join
    come straight from a shuffle and AQE can split the rows of a hub. Every round is
    written to the shared folder, so lost executors cost one round. Rounds end when the
    edges are stars; edges that are none after ``max_rounds`` are an error.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "cc")
    rounds = 0
    while not _stars(e):
        if rounds == max_rounds:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
        rounds += 1
        last = e
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-low")
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "cc-large")
        discard(last, low)
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")), "cc-low")
        # a node of one smaller neighbour keeps its edge; the others' neighbours meet at the least
        small = large.join(low.where("c > 1").select("a", "m").hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        discard(large, low)
    roots = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
