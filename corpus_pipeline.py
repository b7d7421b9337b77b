"""From raw documents to packed sequences: quality, toxicity, near-duplicates, mixture, packing.

Each stage takes the documents that its predecessor kept.  The labels beside the documents teach the first two.

Defined results: null and empty texts are documents without words, of which one stays; rows without an id are told apart by
their text; repeated rows are one document after the third stage; labels of ids that aren't there or are null teach nothing;
columns that documents have besides pass all stages but the last, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

import dataclasses

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import mixing, packing, quality, simhash, toxicity
from tablewright.llm.shared import stored

#: No document twice in one corpus; nine tenths of its tokens.
RECIPE = dataclasses.replace(mixing.RECIPE, epochs=1, tenths=9, seed="corpus-1")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    marked = quality.taught(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.assess(docs, quality.learn(docs, marked), marked, only_kept=True)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.7."""
    return toxicity.keep_civil(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return simhash.keep_first(docs, simhash.FIVE_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the target weights of domains, languages and sources."""
    return mixing.mixed(docs, RECIPE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1,024 tokens."""
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    digest = out.pieces.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    certificate = {"n_sequences": F.lit(out.bins).cast("long"), "least_sequences": F.lit(out.bound).cast("long")}
    return digest.join(out.places, "key").drop("key").withColumns(certificate)


STAGES = [("quality", good), ("toxicity", civil), ("near_duplicates", unique), ("mixing", mix), ("packing", packed)]

#: The learnt stages have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
