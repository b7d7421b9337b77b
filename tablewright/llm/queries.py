"""The training-data queries: one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in the file format and read back."""
    from tablewright.llm.token_output import read_tokens, write_tokens

    files = write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, files, with_ids=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from two folds of three."""
    from tablewright.llm.toxicity import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    from pyspark.sql import functions as F

    from tablewright.llm.packing import pack

    packed = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    digest = packed.pieces.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    certificate = {"n_sequences": F.lit(packed.bins).cast("long"), "least_sequences": F.lit(packed.bound).cast("long")}
    return digest.join(packed.places, "key").drop("key").withColumns(certificate)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents: own evidence with their host's and path's rates."""
    from pyspark.sql import functions as F

    from tablewright.llm.quality import assess, learn, taught

    docs, marked = _table(spark, sf_dir, "documents"), taught(_table(spark, sf_dir, "labels"))
    found = assess(docs, learn(docs, marked), marked)
    names = {"__evidence": "evidence", "__host_rate": "host_rate", "__path_rate": "path_rate", "__quality": "quality_score", "__keep": "keep"}
    return found.select("doc_id", "source", "lang", *[F.col(k).alias(v) for k, v in names.items()])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All uses of documents in a mixture to target weights."""
    from tablewright.llm.mixing import RECIPE, selected

    return selected(_table(spark, sf_dir, "documents"), RECIPE)


def op6_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    from tablewright.llm.digest import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from tablewright.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every row whose id is divisible by 100, among all rows."""
    from tablewright.llm.ann import build, search, usable

    rows = usable(_table(spark, sf_dir, "embeddings"))
    return search(build(rows, 10), rows.where("vec_id % 100 = 0"), 10)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near copies of every document."""
    from pyspark.sql import functions as F

    from tablewright.llm.simhash import FOUR_BITS, near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), FOUR_BITS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learnt from six folds of seven."""
    from tablewright.llm.lm_score import train_and_score

    return train_and_score(_table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that occur in windows of benchmark items."""
    from tablewright.llm.decontaminate import marked

    return marked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and folds of all documents in a tree over sources."""
    from tablewright.llm.merkle import manifest

    return manifest(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100, among all rows."""
    from tablewright.llm.negatives import mine, usable

    return mine(usable(_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_digest": op6_digest,
    "op7_html": op7_html,
    "op8_ann": op8_ann,
    "op9_simhash": op9_simhash,
    "op10_lm_score": op10_lm_score,
    "op11_decontamination": op11_decontamination,
    "op12_merkle": op12_merkle,
    "op13_hard_negatives": op13_hard_negatives,
}


def _oracle_sql() -> dict[str, str]:
    from tablewright.llm import decontaminate, merkle, mixing, negatives

    return {"op5_mixing": mixing.oracle(mixing.RECIPE), "op11_decontamination": decontaminate.oracle(), "op12_merkle": merkle.oracle(), "op13_hard_negatives": negatives.oracle()}


ORACLE_SQL: dict[str, str] = _oracle_sql()
