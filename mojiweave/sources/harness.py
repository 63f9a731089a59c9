"""The study's words from the source file of its test harness, checked against the recorded snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.sources.fixed import OOV_WORDS, PHONETIC_WORDS

# --- fixed values: what stands before and after the two lists in the file, and how a word stands in each ---
ENGLISH_LIST, ENGLISH_END, ENGLISH_WORD = "private static readonly EvalToken[] EnOov = new[]", "}.Select", r'"([a-z]+)"'
JAPANESE_LIST, JAPANESE_END, JAPANESE_WORD = "JaPhoneticOnly =", "];", r'new\("([a-z]+)"'


def harness_words(spark: SparkSession, path: str) -> DataFrame:
    """(word, language, ord) of a harness file: the lists as they stand there."""
    source = spark.read.text(path, wholetext=True)

    def words(start: str, end: str, word: str):
        after = F.when(F.instr("value", start) > 0, F.substring_index("value", start, -1))
        return F.regexp_extract_all(F.substring_index(after, end, 1), F.lit(word), F.lit(1))

    lists = {"English": words(ENGLISH_LIST, ENGLISH_END, ENGLISH_WORD), "Japanese": words(JAPANESE_LIST, JAPANESE_END, JAPANESE_WORD)}
    found = source.select(F.explode(F.array(*(F.struct(F.lit(k).alias("language"), v.alias("words")) for k, v in lists.items()))).alias("x"))
    return found.select("x.language", F.posexplode("x.words").alias("ord", "word")).select("word", "language", "ord")


def checked_harness_words(spark: SparkSession, path: str) -> DataFrame:
    """The same; a file whose lists are not those that the study was made with is refused."""
    found = harness_words(spark, path)
    snapshot = spark.createDataFrame([(w, k, i) for k, x in (("English", OOV_WORDS), ("Japanese", PHONETIC_WORDS)) for i, w in enumerate(x)], "word string, language string, ord int")
    if not (found.exceptAll(snapshot).isEmpty() and snapshot.exceptAll(found).isEmpty()):
        raise ValueError("the harness's words differ from the recorded snapshot of the study")
    return found
