"""The corpus pipeline: from raw documents to token ids. Each stage works on the stored rows of the stage before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelog.llm import chosen_path, exact_dedup, language, sentencepiece, suffix_arrays
from sievelog.llm.common import held_out, small_batches
from sievelog.sources.store import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the dictionaries tell; the fold of the language query stays out of the learning."""
    small_batches(spark)
    model = language.learn(docs.filter(~held_out()))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = language.identify(docs.select(row.alias("_row"), F.col("text")), model)
    return judged.filter(~F.col("rejected")).select("_row.*")


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space apart."""
    small_batches(spark)
    return exact_dedup.keep_first(docs)


def first_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar five-word shingles connect."""
    small_batches(spark)
    return chosen_path.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a notable share of benchmark words."""
    small_batches(spark)
    return suffix_arrays.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, and a digest of the text that decoding them gives."""
    small_batches(spark)
    return sentencepiece.with_ids(docs, "piece_bpe_32k.model").select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language identification", known_language),
    ("exact deduplication", first_copies),
    ("n-gram Jaccard join", first_near_copies),
    ("benchmark decontamination", clean_of_benchmark),
    ("SentencePiece encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs


#: Compression, sampled paths and merging have no SQL form; a test holds the rows against brute force.
ORACLE_SQL = None
