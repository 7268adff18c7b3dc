"""From raw documents to packed training sequences: five stages, each written and read again before the next.

Quality rules, line dedup, near-duplicate removal (five words, similarity 0.8), mixing to target weights and best-fit
packing. All but the last return the columns of ``documents``; the last returns one row per packed piece with its text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginflow.llm.jaccard import keep_one
from marginflow.llm.lines import dedup_lines
from marginflow.llm.mixing import mix, training_order
from marginflow.llm.packing import exact_cluster, pack_documents
from marginflow.llm.quality import judge
from marginflow.session import scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the certified cutoffs of their language.

    Null and empty texts have under 20 words and go. A null lang is a language of its own. Rows are judged by their own
    text and lang, so repeated rows and rows with a null doc_id stay or go alike. A value at a cutoff passes.
    """
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins shared lines; every document stays, and n_chars follows its text.

    A shared line stays in the largest doc_id that has it, in all rows of that doc_id. Null texts become empty. Rows with
    a null doc_id count as one document, which never holds a line that others have too.
    """
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the longest, of equally long ones the largest doc_id.

    So of copies from which shared lines were taken, the one that keeps the lines stays. Rows are judged by their own
    text: other texts of a repeated doc_id stay, and of rows with a null doc_id one of each group stays. Documents
    without words link with nothing.
    """
    return keep_one(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order; a copy cut by its target stays if most of it is taken.

    A null source is a source of its own. Documents without words are not taken. Repeated rows are documents of their
    own; rows with a null doc_id are shuffled by all that they hold.
    """
    return training_order(mix(docs), most_words=True).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words; copies of one text never share a bin.

    Null and empty texts are one piece without words. Null sources and null doc_ids are kept as they are; repeated rows,
    as the copies that the mix takes, are packed each.
    """
    return pack_documents(docs.withColumn("cluster", exact_cluster()), with_text=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Best-fit search has no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
