"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.

The pipeline holds iterative and hashed steps that SQL cannot express (``ORACLE_SQL`` is None);
its stages are tested against brute-force versions in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brokerlens.llm.common import Scratch, documents
from brokerlens.llm.line_dedup import dedup_lines
from brokerlens.llm.mixing import mix_documents
from brokerlens.llm.packing import pack_documents
from brokerlens.llm.simhash import keep_one_of_each
from brokerlens.llm.toxicity import drop_toxic, train

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field learned from the labels does not reject."""
    return drop_toxic(docs, train(docs, documents(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one holds; ``n_chars`` follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of linked fingerprints."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: weights 3, 1, 2 repeating, 150 % of all words, two epochs at most."""
    return mix_documents(docs, budget_share=1.5, max_epochs=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as pieces of sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n + 1 == len(STAGES):
            return out
        kept = scratch.table(out)
        if n:
            scratch.drop(docs)
        docs = kept
    return docs
