"""The corpus pipeline: five stages over documents, each calling one operator of corpusloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. Each result is written as Parquet and read again as the next stage's
docs. All stages but the last return the columns of documents. Nulls, empty texts, repeated rows and empty tables are
handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontam, lines, quality, similar
from corpusloom.llm.common import bounded_batches, scratch, staged, table, text_or_empty, unstage


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows a rewritten text."""
    return docs.withColumn("n_chars", F.length(text_or_empty()).cast("long")) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled documents outside the held-out fold."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net).filter("predicted = 1").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated three-line windows cut out; a document that loses all its lines goes."""
    cut = lines.dedup_lines(docs).filter("n_removed = 0 or n_removed < n_lines")
    return _with_length(cut.select(docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return similar.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the token ids and of the text that decoding gives."""
    bounded_batches(spark)
    return bpe.encode_documents(docs.select("doc_id", "text"), *bpe.public_ranks()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_repeated_lines),
    ("near duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("tokens", encode),
]

#: A trained classifier, MinHash and BPE can't be said in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:  # what the stage itself wrote goes
            after = keep(staged(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        unstage(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
