"""From raw documents to token ids: five stages, each over all that the one before kept.

A stage is a function of (spark, docs, sf_dir). Its rows are written as Parquet and read
again as the next one's ``docs``; all but the last keep the columns of ``docs``.

Defined cases: a null text stays null until the last stage, where it has no ids; texts
without words are never toxic, equal nothing and get no second copy; rows of equal doc_id
and text count as one document, all of which stay or go together; a null doc_id stays,
since it equals nothing; a null source is a source of its own; empty tables give an empty
table; columns of any name and any number are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordmill.llm import bpe, jaccard, lines, mixing, toxicity
from wordmill.llm.shared import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand earlier in the corpus."""
    return lines.deduplicated(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with digests of them and of what they decode to."""
    return bpe.encode(docs.select("doc_id", "text"), bpe.vocabulary_bytes())


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("mixing", mix),
    ("bpe", tokens),
]

#: No SQL states trained scores and byte-pair merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
