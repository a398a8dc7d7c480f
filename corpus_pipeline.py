"""The corpus pipeline: documents cleaned, deduplicated, mixed and encoded, each stage over all that the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, mixing, quality_rules, sentencepieces, simhash
from graphloom.llm.common import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    return line_dedup.dedup(docs, min_docs=10, min_chars=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    return simhash.dedup(docs, width=4, max_bits=4)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture: from file to file, and within each."""
    return mixing.mix(docs, power=0.5, block=16, slots=500).drop("position")


def placed(docs: DataFrame) -> DataFrame:
    """docs, read from the files of one write, with ``position``: how many rows come before by part-file number and row in the file."""
    number = lambda pattern: F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("int")
    rows = docs.select("*", number(r"^part-(\d+)").alias("__gl_part"), number(r"-c(\d+)\.").alias("__gl_split"), F.col("_metadata.row_index").alias("__gl_row"))
    files = rows.groupBy("__gl_part", "__gl_split").agg(F.count(F.lit(1)).alias("n"))  # one row a file
    before = Window.orderBy("__gl_part", "__gl_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("__gl_part", "__gl_split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__gl_start"))
    joined = rows.join(F.broadcast(starts), ["__gl_part", "__gl_split"])
    return joined.select(*docs.columns, (F.col("__gl_start") + F.col("__gl_row")).alias("position"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """position in the mixture, doc_id, ids, n_ids and the SHA-256 of what the ids decode to."""
    named = placed(docs).select(F.struct("position", "doc_id").alias("at"), "text")
    coded = sentencepieces.encode(named, public_tokenizers.path("piece_bpe_32k.model"), id_col="at")
    return coded.select("at.position", "at.doc_id", "ids", "n_ids", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

#: The encoding stage can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
