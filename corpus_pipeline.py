"""Corpus pipeline: five stages over ``documents``, each one operator of ``sluice.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``docs``; rows are told apart by id and text together, so null and
repeated ids and repeated rows are safe. ORACLE_SQL is None: learned models, text
surgery and iterated fitting are not SQL; the tests hold the stages against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.deploy import ship
from sluice.llm import common, decontaminate, mixing, near_duplicates, substring_dedup, toxicity

#: target token shares of the quality labels' domains
MIX_WEIGHTS = {1: 0.97, 0: 0.03}
#: words of a passage that may not repeat
PASSAGE_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects (predicted 1) go."""
    ship(spark)
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    src = docs.select("doc_id", "text", *(F.col(c).alias(f"kept_{c}") for c in extra))
    train = common.crc_mod(F.col("doc_id"), 5) != 0
    out = toxicity.score_toxicity(src, common.read(spark, sf_dir, "labels"), train, keep=("text", *(f"kept_{c}" for c in extra)))
    back = {c: f"kept_{c}" for c in extra}
    return out.where("predicted = 0").select(*(F.col(back.get(c, c)).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the least id."""
    ship(spark)
    return near_duplicates.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of PASSAGE_WORDS words that stand anywhere else too are cut out; emptied documents go."""
    ship(spark)
    cut = substring_dedup.remove_repeats(docs, length=PASSAGE_WORDS, unit=substring_dedup.WORDS, texts_out=True).where("n_removed > 0")
    cut = cut.groupBy(F.col("x1").alias("c1"), F.col("x2").alias("c2")).agg(F.first("kept").alias("kept"))
    x1, x2 = near_duplicates.text_keys(F.col("text"))
    joined = docs.withColumns({"_x1": x1, "_x2": x2}).join(cut, (F.col("_x1") == F.col("c1")) & (F.col("_x2") == F.col("c2")), "left")
    joined = joined.where(F.col("kept").isNull() | (F.trim("kept") != ""))
    new = {"text": F.coalesce("kept", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumn("_key", key)
    found = decontaminate.find_contamination(keyed.select(F.col("_key").alias("doc_id"), "text"), common.read(spark, sf_dir, "benchmark"))
    gone = found.select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(gone, "_key", "left_anti").select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: id, tokens, domain posteriors and rate of each document of rate over 0."""
    ship(spark)
    return mixing.mix(docs, common.read(spark, sf_dir, "labels"), MIX_WEIGHTS, label="quality").where("rate > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_domains),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
