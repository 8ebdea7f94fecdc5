"""A corpus pipeline of five stages over ``documents``; each stage calls one operator of ``armwave.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armwave.llm import jaccard, mixing, pieces, quality, suffixes
from armwave.session import scratch_path

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REPEATED_WORDS = 50  # words of a passage that must not occur twice


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy prose-1 rejects go."""
    return quality.keep_clean(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return jaccard.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that start more than once are cut out wherever they are; ``n_chars`` follows."""
    return suffixes.without_repeats(docs, length=REPEATED_WORDS, window=REPEATED_WORDS // 2, unit="word")


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix of sources: some documents come twice, some not at all."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with piece ids, their number, and whether they decode to the text."""
    vocabulary = pieces.load(spark, MODEL)
    done = pieces.encode(docs, vocabulary, round_trip="round_trip")
    return done.select(*docs.columns, "piece_ids", F.coalesce(F.size("piece_ids"), F.lit(0)).alias("n_pieces"), "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mixing_to_targets),
    ("SentencePiece encoding and decoding", sentencepiece),
]

# The last stage's segmentation cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
