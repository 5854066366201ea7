"""The corpus pipeline: stages over ``documents``, each one of the operators in ``drawstats.llm``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawstats.llm import fm_dedup, mixing, pieces_codec, quality, shingle_sets
from drawstats.llm.common import merged, stored, table

ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key() -> Column:
    """What joins go by: the id, where a null id is one value like any other."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality_rules(docs, keep=("text", "lang", "source", "n_chars")).filter("kept").select(*COLUMNS)


def _row_hashes() -> list[Column]:
    """128 bits that tell rows with any difference apart."""
    parts = [F.col(c) for c in COLUMNS] + [F.isnull(c) for c in COLUMNS]
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("row"), *parts).alias("h2")]


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class (five-word shingles, Jaccard similarity 0.8 or more).

    That with the smallest id stays, of equal ids that with the smallest hash;
    rows without an id come last.  Rows are told apart by all their columns, so
    a null or repeated id drops none that is in a class of its own.
    """
    docs = docs.select(*COLUMNS, *_row_hashes())
    roots = shingle_sets.near_classes(docs).join(merged(docs.select("h1", "h2", F.isnull("doc_id").alias("none"), "doc_id").distinct()), ["h1", "h2"])
    keep = roots.groupBy("root").agg(F.min(F.struct("none", "doc_id", "h1", "h2")).alias("k")).select("k.h1", "k.h2")
    return docs.join(merged(keep), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of twenty words that occur earlier; a document that loses all its words goes."""
    out = fm_dedup.remove_repeated_words(docs, keep=("text", "lang", "source"))
    text = F.when(F.col("n_removed") == 0, F.col("rest.k0")).otherwise(F.col("kept"))
    out = out.filter("n_words = 0 OR n_removed < n_words").select("doc_id", text.alias("text"), F.col("rest.k1").alias("lang"), F.col("rest.k2").alias("source"))
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its rate under the target weights says; none of toxic ones."""
    rates = mixing.mixed_rates(docs, table(spark, sf_dir, "labels"), keep=("text", "lang", "source", "n_chars")).filter("copies > 0")
    kept = [F.col(f"rest.k{k}").alias(c) for k, c in enumerate(COLUMNS[1:])]
    return rates.select("doc_id", *kept, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return pieces_codec.encode(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
