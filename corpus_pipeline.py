"""From raw documents to packed training sequences, in five stages.

Every stage gets all that the one before it kept, as a table read from Parquet, and returns the columns of `documents`;
the last returns packed pieces. Rows with a null text are rejected by the quality rules, as texts without words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, neardup, packing, passages, quality
from millrace.llm.components import Scratch
from millrace.llm.queries import table, vocabulary

#: Words of a passage that is cut where it repeats, and of the windows the search starts from.
PASSAGE, PASSAGE_START = 40, 10


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like trusted text; the others go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of equal or near-equal texts."""
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages that a document with a smaller id has too are cut out of `text`."""
    cut = passages.cut_repeats(docs, PASSAGE, PASSAGE_START)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 ids."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The likelihood ratio, the similarity classes and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage returns is stored, and dropped when the next one's rows are stored."""
    room = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = room.store(stage(spark, docs, sf_dir))
        if before is not None:
            room.drop(before)
        before = docs
    return docs
