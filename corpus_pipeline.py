"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. The first four return the
columns of documents; the last adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, line_dedup, minhash_forest, queries, sentencepiece_lattice, toxicity
from strandline.llm._shared import forget_since, stage_mark, stored

#: Words of a shingle, and the shared part of two documents' shingles that makes them near-duplicates.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.3; it learns from the labels of this input's documents."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows lose all but their first occurrence; a document with no line left goes."""
    lines, removed = _free("sl_lines", docs), _free("sl_removed", docs)
    kept = line_dedup.dedup_lines(docs, lines, removed)
    return kept.where((F.col(lines) == 0) | (F.col(removed) < F.col(lines))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (the least doc_id)."""
    groups = minhash_forest.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT)
    gone = _free("sl_gone", docs)
    return docs.join(groups.where("not kept").select(F.col("doc_id").alias(gone)).distinct(), F.col("doc_id") == F.col(gone), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and the number of these."""
    encoded = sentencepiece_lattice.encode_texts(docs, queries.SENTENCEPIECE_MODEL)
    return encoded.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("minhash_near_dedup", dedup_near), ("benchmark_decontamination", drop_leaks), ("sentencepiece", encode)]

#: A trained model and an encoder are among the stages, so no SQL gives these rows; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another; of the tables they store only the last stage's rows stay."""
    docs, begin = spark.read.parquet(f"{sf_dir}/documents.parquet"), stage_mark()
    for _, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir))
        forget_since(spark, begin, path)
    return docs
