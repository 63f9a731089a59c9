"""The dictionary, kana and profile words as small DataFrames, and texts and words of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.functions.syntax import normalize
from mojiweave.sources.fixed import ENGLISH_SEEDS, ENTRIES, JAPANESE_SEEDS, KANA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    """125 entries: raw, output, language, weight, evidence, ord."""
    return spark.createDataFrame([(e.raw, e.output, e.language, e.weight, e.evidence, e.ord) for e in ENTRIES], "raw string, output string, language string, weight double, evidence string, ord int")


def kana_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KANA.items()), "romaji string, kana string")


def profile_words(spark: SparkSession) -> DataFrame:
    """Words of the two language profiles: the dictionary and the seeds, repeats kept."""
    seeds = spark.createDataFrame([("Japanese", w) for w in JAPANESE_SEEDS] + [("English", w) for w in ENGLISH_SEEDS], "language string, word string")
    return lexicon(spark).select("language", F.col("raw").alias("word")).unionByName(seeds)


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct runs of ASCII letters of all documents, lower-cased: what a keyboard of letters can type. A word with an accent gives the runs on either side of it."""
    text = normalize(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0)))).alias("word")).distinct()
