"""From documents to packed training sequences: five stages, each written to the shared folder and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, lines, packing, simhash, toxicity
from plumbline.llm.queries import QUERIES, TOKENIZER, query
from plumbline.session import scratch_dir, tune


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones, doesn't call toxic."""
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.classifier(docs, labels, F.lit(True))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return toxicity.score(rows, model).where("predicted = 0").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rid of lines that a later one repeats; n_chars follows the text."""
    tune(spark)
    kept = lines.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 64-bit SimHash over four-word shingles, linked at four or fewer differing bits."""
    tune(spark)
    return simhash.keep_one(docs, words=4, bits=64, radius=4)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    tune(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [("toxicity", toxic_filter), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", benchmark_filter), ("best-fit packing", pack)]

# Hashes, a fitted model and a genetic search have no counterpart in SQL.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


__all__ = ["ORACLE_SQL", "QUERIES", "STAGES", "run"]
