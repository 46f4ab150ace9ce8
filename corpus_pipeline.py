"""The corpus pipeline: documents in, token ids of the mixture out.

Each stage's result is written as Parquet to the folder that executors share and read again by the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, exact_dedup, line_quality, mixing, prob_minhash
from millrace.llm.common import load, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that too many documents of a source share; documents that are depleted by it go. Families of near copies
    count once, so that ``near`` can keep one document of each. Null, empty and blank texts go; a null source is a source;
    rows with null or repeated ids are each judged; repeated rows stay; other columns stay."""
    return line_quality.drop_frequent_lines(docs, families=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest id (a null id last; of equal rows any). Null texts stay, empty
    texts equal each other; all columns stay."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id. Rows with a null id or text stay, and
    texts without a word; rows that share an id stay or go together; all columns stay."""
    return prob_minhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights select, once for each epoch; the one in which a leaf's budget ends is cut there.
    Documents without a word go; a null language or source is a leaf; rows that share an id are taken together; all columns
    stay, ``n_chars`` as of the text."""
    mixed = mixing.mix_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else mixed


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) of each document of the mixture; a null id stays null."""
    return bpe.bpe_encode(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("bpe", encode)]

#: SQL can't express near-duplicates by ProbMinHash or BPE; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
