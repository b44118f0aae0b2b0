"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination and a tokenizer round trip.

Every stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last one adds
what encoding gives. ``run`` writes each stage as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variform.llm import common, decontaminate, language_id, line_dedup, minhash_dedup, sentencepiece_bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those whose margin between languages is narrow; lang is what was found."""
    model = language_id.fit(docs)
    found = language_id.identify(docs, model, keep=docs.columns)
    return found.where("NOT rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs of 50 words or more; documents that consisted of nothing else go."""
    out = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with five-word shingle similarity of 0.8 or more."""
    return minhash_dedup.drop_near_copies(docs).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, and whether decoding gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = sentencepiece_bpe.encode(docs, model, decoded_col="decoded")
    n_tokens = F.size("ids").cast("long").alias("n_tokens")
    return back.select(*COLUMNS, "ids", n_tokens, F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode_pieces),
]

#: Compression sizes and model files are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
