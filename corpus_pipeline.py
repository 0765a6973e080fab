"""The corpus pipeline: documents to packed training sequences, one operator a stage.

Defined results, each stage's operator saying more: every stage but the last returns the columns of its documents under
their names, whatever these are, with n_chars, where there is one, told anew for changed texts. A null text goes through as
null up to packing, where it counts as empty; rows without a doc_id pass toxicity and personal data as any, stay whole in
repeats, and of those with one text that no named row has, one stays in near_duplicates; repeated rows count once there,
ties going to the smallest doc_id. Without labels of both kinds no document is toxic. Very long texts are read whole in all
stages; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewave.llm._common import table, written
from tidewave.llm.neardup import one_of_each
from tidewave.llm.packing import pack_documents
from tidewave.llm.private import sanitise
from tidewave.llm.substrings import without_repeats
from tidewave.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


#: The stages in order; each one's result, written as Parquet and read again, is the next one's documents.
STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeats", repeats), ("personal_data", personal_data), ("packing", packing)]

#: The kernel machine, weighted sampling and tokenizing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
