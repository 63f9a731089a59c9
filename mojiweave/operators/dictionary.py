"""Texts met with the dictionary: substring equi-joins with a broadcast of its 125 entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mojiweave.sources.fixed import ENTRIES
from mojiweave.sources.scratch import written

LENGTHS = sorted({len(e.raw) for e in ENTRIES})
#: Characters of a part of texts, about: what a task holds of their places and edges does not grow with the number of texts.
PART = 1 << 17


def hits(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """texts (text, ...) with a row for each place where an entry stands: start, end (0-based, half-open) and the entry.

    Only lengths that occur in the dictionary are cut out, so a text makes at most length x 9 candidates.
    """
    starts = texts.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("text") - 1))).filter(F.length("text") > 0)
    cut = starts.withColumn("n", F.explode(F.array(*(F.lit(n) for n in LENGTHS)))).filter(F.col("start") + F.col("n") <= F.length("text"))
    cut = cut.withColumn("raw", F.substr("text", F.col("start") + 1, F.col("n")))
    return cut.join(F.broadcast(lexicon), "raw").withColumn("end", F.col("start") + F.col("n")).drop("n")


def counted(texts: DataFrame) -> tuple[DataFrame, int]:
    """The distinct texts as a written table, and in how many parts to deal them: few bytes are much work, so each core has some, and more texts make more parts."""
    each = written(texts.select("text").filter("text is not null").distinct())
    characters = each.agg(F.sum(F.length("text"))).first()[0] or 0
    return each, max(4 * texts.sparkSession.sparkContext.defaultParallelism, -(-characters // PART))


def dealt(texts: DataFrame) -> DataFrame:
    """The distinct texts, dealt by their characters and the number of cores."""
    each, parts = counted(texts)
    return each.repartition(parts, "text")


def prefix_hits(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """texts (text, ...) with the entries that begin with the whole text and are longer."""
    longest = max(LENGTHS)
    prefixes = lexicon.withColumn("text", F.explode(F.transform(F.sequence(F.lit(1), F.length("raw")), lambda n: F.substr("raw", F.lit(1), n)))).filter(F.length("text") < F.length("raw"))
    return texts.filter(F.length("text") < longest).join(F.broadcast(prefixes), "text")


def confidence(weight: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (weight - 3.5) / 3.5))


def boundary_support(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(text, position, support) of every place of the distinct texts: how well entries end and start there.

    An entry that only begins with the rest of the text counts three quarters. Both sides: the
    geometric mean; one: 0.35 of it; 0 at either end of the text.
    """
    texts = texts.select("text").distinct().filter(F.length("text") > 0)
    sure, zero = confidence(F.col("weight")), F.lit(0.0)
    found = hits(texts, lexicon).select("text", F.inline(F.array(F.struct(F.col("end").alias("position"), sure.alias("l"), zero.alias("r")), F.struct(F.col("start").alias("position"), zero.alias("l"), sure.alias("r")))))
    # an entry is longer than the rest of a text that it goes on from: only the last places can have one
    last = F.sequence(F.greatest(F.lit(1), F.length("text") - max(LENGTHS) + 1), F.length("text") - 1)
    rests = texts.filter(F.length("text") > 1).select(F.col("text").alias("whole"), F.explode(last).alias("position")).withColumn("text", F.substr("whole", F.col("position") + 1, F.length("whole")))
    begun = prefix_hits(rests, lexicon).select(F.col("whole").alias("text"), "position", zero.alias("l"), (0.75 * sure).alias("r"))
    # what a text has at its places comes together as one small list; places are made after that, and are in no shuffle
    held = found.unionByName(begun).groupBy("text").agg(F.collect_list(F.struct("position", "l", "r")).alias("held"))
    each = texts.join(held, "text", "left").select("text", "held", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("position"))
    own = each.select("text", "position", F.filter("held", lambda h: h["position"] == F.col("position")).alias("own"))
    best = lambda side: F.coalesce(F.array_max(F.transform("own", lambda h: h[side])), F.lit(0.0))
    each = own.select("text", "position", best("l").alias("l"), best("r").alias("r"))
    l, r = F.col("l"), F.col("r")
    support = F.when((F.col("position") == 0) | (F.col("position") == F.length("text")), 0.0).when((l > 0) & (r > 0), F.sqrt(l * r)).otherwise(0.35 * F.greatest(l, r))
    return each.select("text", "position", support.alias("support"))


def ends_strong() -> Column:
    """Whether an entry (raw, language, weight) is strong Japanese before a boundary."""
    return (F.col("language") == "Japanese") & (F.col("weight") >= 5.2)


def starts_strong() -> Column:
    """Whether an entry (raw, language, weight, evidence) is strong Japanese after a boundary."""
    kinds = ["japanese-particle", "japanese-verb-suffix", "japanese-auxiliary", "japanese-verb"]
    return (F.col("language") == "Japanese") & (F.col("weight") >= 5.1) & (F.col("evidence").isin(*kinds) | (F.length("raw") >= 3))


def strong_boundaries(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows (text, position) after which strong Japanese starts, or before which it ends, with side."""
    found = hits(texts.select("text").distinct(), lexicon)
    before = found.filter(ends_strong()).select("text", F.col("end").alias("position"), F.lit("before").alias("side"))
    after = found.filter(starts_strong()).select("text", F.col("start").alias("position"), F.lit("after").alias("side"))
    return before.unionByName(after).distinct()
