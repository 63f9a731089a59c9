"""The out-of-vocabulary study as DataFrame operations: character models, proposals, confusion, discordance.

The study's English word list is not available offline; the distinct words of `documents` take its
place, and hash buckets take the place of its seeded shuffle. The Japanese list is the study's own, and so is
its seeded split. So the figures differ from the published ones; the method is the same.
"""

from __future__ import annotations

import random
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.sources.fixed import DECLARED, ENDINGS, ENTRIES, GLUE, OOV_WORDS, PHONETIC_WORDS, STUDY_PARTICLES, STUDY_PREFIXES, STUDY_STOP
from mojiweave.sources.harness import checked_harness_words

ORDER, SMOOTH, ALPHABET = 3, 0.25, 27
SHORTEST, LONGEST = 7, 24
#: English words in the first of so many buckets are development words.
ENGLISH_PARTS = 100
#: The study's seed; of the Japanese words as it shuffles them, how many train, and how many come before those that test.
SEED, JAPANESE_TRAIN, JAPANESE_DEV = 20261010, 55, 70


def japanese_words(spark: SparkSession) -> DataFrame:
    """Distinct Japanese entries in order of declaration: word, ord."""
    return spark.createDataFrame([(e.raw, i) for i, e in enumerate(e for e in ENTRIES if e.language == "Japanese")], "word string, ord int")


def study_words(spark: SparkSession, harness: str | None = None) -> DataFrame:
    """(word, language, ord): the English words that no dictionary has, and Japanese ones that are only phonetic; from a harness file if one is given."""
    if harness is not None:
        return checked_harness_words(spark, harness)
    return spark.createDataFrame([(w, "English", i) for i, w in enumerate(OOV_WORDS)] + [(w, "Japanese", i) for i, w in enumerate(PHONETIC_WORDS)], "word string, language string, ord int")


def english_words(words: DataFrame) -> DataFrame:
    """words (word) that may train the English model: 3 to 24 letters, none of the study's or the dictionary's."""
    known = sorted({e.raw for e in ENTRIES if e.language == "Japanese"} | set(OOV_WORDS) | set(PHONETIC_WORDS) | set(STUDY_STOP))
    stop = words.sparkSession.createDataFrame([(w,) for w in known], "word string")
    return words.select(F.lower("word").alias("word")).filter(F.col("word").rlike("^[a-z]{3,24}$")).distinct().join(F.broadcast(stop), "word", "left_anti")


def ends_like_latin(word: Column) -> Column:
    return F.length(word).between(SHORTEST, LONGEST) & word.rlike(f"({'|'.join(ENDINGS)})$")


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, n): grams of one to three characters of ^word$ that end after the first character."""
    s = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    ends = words.select(s.alias("s"), F.explode(F.sequence(F.lit(2), F.length(s))).alias("i"))
    grams = ends.select("s", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(ORDER), F.col("i")))).alias("z")).select(F.substr("s", F.col("i") - F.col("z") + 1, F.col("z")).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def context_totals(counts: DataFrame) -> DataFrame:
    """(context, total) of gram counts."""
    return counts.groupBy(F.substr("gram", F.lit(1), F.length("gram") - 1).alias("context")).agg(F.sum("n").alias("total"))


def likelihoods(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, likelihood): mean log-probability of each character after the longest context that was seen.

    Words explode into places, and each place meets the contexts in equi-joins. A model holds at
    most 28 + 28**2 + 28**3 grams, so it is broadcast.
    """
    totals = context_totals(counts)
    s = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    places = words.select("word").distinct().select("word", s.alias("s"), F.explode(F.sequence(F.lit(2), F.length(s))).alias("i"))
    c2 = F.when(F.col("i") >= 3, F.substr("s", F.col("i") - 2, F.lit(2)))
    out = places.select("word", c2.alias("c2"), F.substr("s", F.col("i") - 1, F.lit(1)).alias("c1"), F.substr("s", F.col("i"), F.lit(1)).alias("c"))
    for name in ("c2", "c1"):
        out = out.join(F.broadcast(totals.select(F.col("context").alias(name), F.col("total").alias(f"t_{name}"))), name, "left")
    out = out.join(F.broadcast(totals.filter("context = ''").select(F.col("total").alias("t_0"))), how="left")
    context = F.when(F.col("t_c2").isNotNull(), F.col("c2")).when(F.col("t_c1").isNotNull(), F.col("c1")).otherwise("")
    total = F.coalesce("t_c2", "t_c1", "t_0", F.lit(0))
    out = out.withColumn("gram", F.concat(context, "c")).withColumn("total", total).join(F.broadcast(counts), "gram", "left")
    return out.groupBy("word").agg(F.avg(F.log((F.coalesce("n", F.lit(0)) + SMOOTH) / (F.col("total") + SMOOTH * ALPHABET))).alias("likelihood"))


def differences(words: DataFrame, english: DataFrame, japanese: DataFrame) -> DataFrame:
    """(word, difference) of the two models' likelihoods, english less japanese; english and japanese are gram counts."""
    e, j = likelihoods(words, english), likelihoods(words, japanese)
    return e.join(j.withColumnRenamed("likelihood", "j"), "word").select("word", (F.col("likelihood") - F.col("j")).alias("difference"))


def choose_threshold(dev: DataFrame) -> DataFrame:
    """One row (recall, threshold): of the development values (language, difference), rounded to 5, and 0, the one with the best recall of English at no more than 5 % of Japanese above it; of equals the lowest."""
    # a value lies above m / 10**5 if its ceiling in these units does: counts per ceiling say all, and there
    # are no more of them than differences of mean log-likelihoods have steps of 10**-5 (some two million)
    unit = F.lit(100_000)
    above = dev.groupBy(F.ceil(F.col("difference") * unit).alias("at")).agg(F.count_if(F.col("language") == "Japanese").alias("ja"), F.count_if(F.col("language") == "English").alias("en"))
    zero = dev.sparkSession.range(1).select(F.lit(0).cast("long").alias("at"))
    probes = dev.select(F.round(F.col("difference") * unit).cast("long").alias("at")).unionByName(zero).distinct()
    marks = above.withColumn("probe", F.lit(0)).unionByName(probes.select("at", F.lit(0).cast("long").alias("ja"), F.lit(0).cast("long").alias("en"), F.lit(1).alias("probe")))
    from pyspark.sql import Window

    over = Window.orderBy(F.desc("at"), F.desc("probe")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marks.withColumn("ja", F.sum("ja").over(over)).withColumn("en", F.sum("en").over(over)).filter("probe = 1")
    sums = dev.agg(F.count_if(F.col("language") == "Japanese").alias("n_ja"), F.count_if(F.col("language") == "English").alias("n_en"))
    eligible = counted.join(F.broadcast(sums)).filter(F.col("ja") <= F.floor(F.col("n_ja") * 0.05))
    return eligible.select(F.coalesce(F.try_divide("en", "n_en"), F.lit(0.0)).alias("recall"), (F.col("at") / unit).alias("threshold")).orderBy(F.desc("recall"), "threshold").limit(1)


def bucket(word: Column, n: int) -> Column:
    """A word's part of n, by a digest: takes the place of a seeded shuffle and does not depend on the other words."""
    return F.conv(F.substr(F.md5(word.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long") % n


def seeded_order(words: list[str], seed: int = SEED) -> list[str]:
    """A list of fixed size as the study shuffles it."""
    order = list(words)
    random.Random(seed).shuffle(order)
    return order


def japanese_places(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """(word, place): the Japanese entries in the order of the seeded shuffle."""
    return spark.createDataFrame(list(zip(seeded_order(DECLARED, seed), range(len(DECLARED)), strict=True)), "word string, place int")


def split(english: DataFrame, seed: int = SEED) -> DataFrame:
    """(word, language, part) of the words: train, dev or test; Japanese ones are the study's own."""
    e, j = bucket(F.col("word"), ENGLISH_PARTS), F.col("place")
    parts = english.select("word", F.lit("English").alias("language"), F.when(e == 0, "dev").otherwise("train").alias("part"))
    japanese = japanese_places(english.sparkSession, seed)
    return parts.unionByName(japanese.select("word", F.lit("Japanese").alias("language"), F.when(j < JAPANESE_TRAIN, "train").when(j < JAPANESE_DEV, "dev").otherwise("test").alias("part")))


def models(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gram counts of both languages' training words, and one row (recall, threshold) from the development words."""
    e, j = (gram_counts(parts.filter((F.col("part") == "train") & (F.col("language") == k))) for k in ("English", "Japanese"))
    return e, j, threshold(parts, e, j)


def threshold(parts: DataFrame, english: DataFrame, japanese: DataFrame) -> DataFrame:
    """choose_threshold() of the development words under the two models' gram counts."""
    dev = parts.filter("part = 'dev'")
    return choose_threshold(differences(dev, english, japanese).join(dev.select("word", "language"), "word"))


def tested(words: DataFrame, english: DataFrame, japanese: DataFrame, threshold: DataFrame) -> DataFrame:
    """words (word, ...) with difference and the three tests: shape, model and either. threshold: one row."""
    scored = words.join(differences(words, english, japanese), "word").join(F.broadcast(threshold.select("threshold")))
    scored = scored.withColumn("shape", ends_like_latin(F.col("word"))).withColumn("model", F.col("difference") > F.col("threshold")).drop("threshold")
    return scored.withColumn("either", F.col("shape") | F.col("model"))


def negatives(parts: DataFrame, seed: int = SEED) -> DataFrame:
    """(word, ord): Japanese words of the test part as they were shuffled, then those that are only phonetic."""
    spark = parts.sparkSession
    test = parts.filter("language = 'Japanese' and part = 'test'").join(F.broadcast(japanese_places(spark, seed)), "word").select("word", F.col("place").alias("key"))
    rows = test.unionByName(study_words(spark).filter("language = 'Japanese'").select("word", (F.col("ord") + len(ENTRIES)).alias("key")))
    from pyspark.sql import Window

    return rows.select("word", (F.row_number().over(Window.orderBy("key")) - 1).alias("ord"))  # some thirty words


def by_test(rows: DataFrame, *keep: str) -> DataFrame:
    """rows of tested() once for each test: keep, test, predicted."""
    tests = F.array(*(F.struct(F.lit(k).alias("test"), F.col(k).alias("predicted")) for k in ("shape", "model", "either")))
    return rows.select(*keep, F.inline(tests))


def localized(streams: DataFrame, spans: DataFrame) -> DataFrame:
    """(test, positive_cases, gold_recovered, positive_spans, negative_cases, negative_with_any, negative_spans).

    streams: (text, start, end, positive boolean), start and end of the word inside; spans: proposed spans
    (text, start, end) with the three tests.
    """
    cases = streams.groupBy("positive").agg(F.count(F.lit(1)).alias("cases"))
    found = by_test(spans, "text", "start", "end").filter("predicted")
    gold = streams.select("text", "positive", F.col("start").alias("s"), F.col("end").alias("e"))
    per_case = found.join(gold, "text").groupBy("test", "positive", "text").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("start") == F.col("s")) & (F.col("end") == F.col("e"))).alias("gold"))
    sums = per_case.groupBy("test", "positive").agg(F.sum("n").alias("spans"), F.count(F.lit(1)).alias("any"), F.count_if("gold").alias("gold"))
    names = streams.sparkSession.createDataFrame([(k,) for k in ("shape", "model", "either")], "test string")
    out = names.join(F.broadcast(cases)).join(sums, ["test", "positive"], "left").na.fill(0, ["spans", "any", "gold"])
    pick = lambda c, positive: F.coalesce(F.max(F.when(F.col("positive") == positive, F.col(c))), F.lit(0)).cast("long")
    return out.groupBy("test").agg(
        pick("cases", True).alias("positive_cases"), pick("gold", True).alias("gold_recovered"), pick("spans", True).alias("positive_spans"),
        pick("cases", False).alias("negative_cases"), pick("any", False).alias("negative_with_any"), pick("spans", False).alias("negative_spans"),
    )


def confusion(predictions: DataFrame, *keys: str) -> DataFrame:
    """A row for each of keys (one without any) from (keys, language, predicted boolean)."""
    pos, neg = F.col("language") == "English", F.col("language") == "Japanese"
    n = predictions.groupBy(*keys).agg(F.count_if(pos).alias("positive"), F.count_if(pos & F.col("predicted")).alias("positive_detected"), F.count_if(neg).alias("negative"), F.count_if(neg & F.col("predicted")).alias("negative_detected"))
    return n.select("*", F.round(F.try_divide("positive_detected", "positive"), 4).alias("recall"), F.round(F.try_divide("negative_detected", "negative"), 4).alias("false_positive_rate"))


def mixed_streams(words: DataFrame) -> DataFrame:
    """words (word, ord, ...) set into a stream: prefix by ord mod 4, particle by ord mod 9; text and the word's span."""
    prefix, after = (F.get(F.array(*(F.lit(x) for x in xs)), F.col("ord") % len(xs)) for xs in (STUDY_PREFIXES, STUDY_PARTICLES))
    return words.withColumn("text", F.concat(prefix, "word", after)).withColumn("start", F.length(prefix)).withColumn("end", F.length(prefix) + F.length("word"))


def glued(words: DataFrame) -> DataFrame:
    """(i, word): a hundred pairs of words (word, ord from 0) with a particle between, of 7 to 24 letters."""
    n = words.count()
    glue = F.get(F.array(*(F.lit(x) for x in GLUE)), (F.col("i") % len(GLUE)).cast("int"))
    pairs = words.sparkSession.range(100).withColumnRenamed("id", "i").withColumn("a", (F.col("i") * 7) % n).withColumn("b", (F.col("i") * 11 + 3) % n)
    out = pairs.join(F.broadcast(words.select(F.col("ord").alias("a"), F.col("word").alias("wa"))), "a").join(F.broadcast(words.select(F.col("ord").alias("b"), F.col("word").alias("wb"))), "b")
    return out.select("i", F.concat("wa", glue, "wb").alias("word")).filter(F.length("word").between(SHORTEST, LONGEST))


def proposed_spans(texts: DataFrame) -> DataFrame:
    """(text, start, end, word) of the spans of letters that may be a word: 7 to 24 long, at the end or before a particle."""
    starts = texts.select("text").distinct().withColumn("start", F.explode(F.sequence(F.lit(0), F.length("text") - 1))).filter(F.length("text") >= SHORTEST)
    ends = starts.filter(F.col("start") + SHORTEST <= F.length("text")).withColumn("end", F.explode(F.sequence(F.col("start") + SHORTEST, F.least(F.col("start") + LONGEST, F.length("text")))))
    spans = ends.withColumn("word", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))).filter(F.col("word").rlike("^[a-zA-Z]+$"))
    rest = F.substr("text", F.col("end") + 1, F.length("text"))
    return spans.filter((F.col("end") == F.length("text")) | rest.rlike(f"^({'|'.join(STUDY_PARTICLES)})"))


def particle_collisions(words: DataFrame) -> DataFrame:
    """(word, particle) of the particles that a word contains."""
    return words.select("word", F.explode(F.filter(F.array(*(F.lit(p) for p in STUDY_PARTICLES)), lambda p: F.contains(F.col("word"), p))).alias("particle"))


def discordance(pairs: DataFrame) -> DataFrame:
    """One row from (first boolean, second boolean): how often only one holds, and the exact two-sided p of that."""
    r = pairs.agg(F.count_if(F.col("first") & ~F.col("second")).alias("a"), F.count_if(F.col("second") & ~F.col("first")).alias("b")).first()
    a, b = r["a"], r["b"]
    p = min(1.0, 2 * sum(comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b))
    return pairs.sparkSession.createDataFrame([(a, b, round(p, 9))], "first_only long, second_only long, p_two_sided double")
