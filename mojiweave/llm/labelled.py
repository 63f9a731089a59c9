"""Labelled rows for fitting: a bounded sample that does not depend on the rows' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the doc_id as text, modulo n. Null: null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents, those with the least hash of doc_id among the usable ones.

    A doc_id that is labelled more than once counts as 1 if any of its labels is; of rows that repeat a
    doc_id the text with the least digest is taken, picked before the shuffle too, so the sample has no more than
    `most` rows however often a doc_id stands there. The join broadcasts no more than `most` small rows.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(usable)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("dig"), "text")).alias("x")
    return rows.groupBy("doc_id", "y").agg(first).select("doc_id", "x.text", "y")
