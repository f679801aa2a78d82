"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``.

Defined cases are those of the operators. Beyond them: a document whose text is wholly made of passages that
earlier documents hold goes with the line dedup, one that was null or blank from the start stays; a row with
a null id is never rejected by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.llm import decontamination, line_dedup, minhash_forest, packing, toxicity
from entrack.llm.common import Scratch, fresh, table

#: Rows with a score from this one on are rejected.
TOXIC = toxicity.THRESHOLD


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the classifier finds toxic; it learns from all labels."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.without_toxic(docs, model, TOXIC)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document, or an earlier part of the same one, holds."""
    cut = line_dedup.deduplicated_lines(docs)
    emptied = (F.size("removed_spans") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(~emptied).drop("removed_spans").select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest id, of each group."""
    groups = minhash_forest.near_duplicates(docs)
    gone_id, gone_key = fresh(docs, "gone_id"), fresh(docs, "gone_key")
    gone = groups.where("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    gone = Scratch(spark, "gone").save(gone, "ids")
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col(gone_id)) & (F.xxhash64(docs["text"]) == F.col(gone_key)), "left_anti")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that hold an item of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document its length bucket and its batch."""
    return packing.pack(docs, packing.word_count(F.col("text")), spread=F.col("text"))


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on what its predecessor wrote."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs


#: The toxicity model is fitted, so SQL cannot express the rows; tests/llm/test_brute_force.py holds each stage against plain Python.
ORACLE_SQL = None
