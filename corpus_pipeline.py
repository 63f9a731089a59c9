"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

quality rules (rejected documents go) -> line dedup (repeated lines go, and documents of which
less than half is left) -> near duplicates (the least doc_id of each group stays) -> decontamination
(documents that hold a benchmark window go) -> packing (the last; a row per piece with its token ids
and its place: packing.sequences() puts them together).
Each stage works on all that its predecessor kept; all but the last return the columns of documents.
Nulls, empty and long texts, repeated rows and empty tables: as each operator defines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.llm import common
from mojiweave.llm.decontamination import drop_contaminated
from mojiweave.llm.line_dedup import drop_repeated_lines
from mojiweave.llm.near_dup import drop_near_duplicates
from mojiweave.llm.packing import pack_documents
from mojiweave.llm.quality_rules import keep_good

#: Jaccard similarity of five-word shingles from which documents are near duplicates here.
SIMILAR = (80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, enough=SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs).withColumn("length", F.col("length").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL cannot express the stages (expectation-maximisation, edit distances, packing).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each keeps is written in the shared folder and read by the next."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with common.scratch_paths() as made:
            docs = common.materialize(stage(spark, docs, sf_dir), f"stage_{name}")
        common.drop_paths(spark, before + made[:-1])  # the last path is the stage's own result
        before = made[-1:]
    return docs
