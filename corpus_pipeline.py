"""A corpus from raw documents to sampled piece ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.

In every stage null and empty texts are texts without words, whole texts are worked on, rows may
repeat, other columns are handed on (the last stage returns its own), and an empty table gives an
empty result. Rows with a null id are kept by stages 1 and 2, which name rows by their id, and treated
like others by the rest; the last stage has no row for a null text. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import decontaminate, quality, sentencepiece_sampling, shingle_join, simhash, suffix_dedup
from loomgrid.llm.common import staged, table


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (7) does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (8): SimHash fingerprints within two bits, or five-word shingles with a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one_per_class(docs, classes_of=shingle_join.near_copy_classes)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that also stand earlier (4)."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item (6)."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document (5): doc_id, draw, n_pieces, ids, log_prob, log_inclusion."""
    drawn = sentencepiece_sampling.encode_samples(docs)
    return drawn.select(F.col("id").alias("doc_id"), "draw", F.size("ids").alias("n_pieces"), "ids", "log_prob", "log_inclusion")


STAGES = [
    ("quality classifier", keep_good_documents),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Stages 1, 3 and 5 have no form in SQL; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs
