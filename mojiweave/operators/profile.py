"""Character n-gram language profiles: counts, scores and advantage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTH, BOUND, NO_LETTERS = 0.35, 2.5, -8.0


def grams_of(word: Column) -> Column:
    """All bigrams, then all trigrams of ^word$."""
    s = F.concat(F.lit("^"), word, F.lit("$"))

    def of(n: int) -> Column:
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substr(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(of(2), of(3))


def profile(words: DataFrame) -> DataFrame:
    """(language, gram, n) of words (language, word)."""
    return words.select("language", F.explode(grams_of(F.col("word"))).alias("gram")).groupBy("language", "gram").agg(F.count(F.lit(1)).alias("n"))


def totals(grams: DataFrame) -> DataFrame:
    """(language, total, vocabulary): at least 1 and 32."""
    return grams.groupBy("language").agg(F.greatest(F.lit(1), F.sum("n")).alias("total"), F.greatest(F.lit(32), F.count(F.lit(1))).alias("vocabulary"))


def scores(words: DataFrame, profile_words: DataFrame) -> DataFrame:
    """words (word: letters) with japanese and english, the mean log-likelihoods of their grams; no letters: NO_LETTERS.

    A word's grams meet the profile in a broadcast join: the profile comes from a few hundred words.
    """
    grams = profile(profile_words)
    below = (F.max(F.when(F.col("language") == k, F.col("total") + SMOOTH * F.col("vocabulary"))).alias(f"below_{k}") for k in ("Japanese", "English"))
    sums = totals(grams).agg(*below)  # one row
    wide = grams.groupBy("gram").agg(*(F.coalesce(F.sum(F.when(F.col("language") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("Japanese", "English")))

    def mean(k: str) -> Column:
        return F.avg(F.log((F.coalesce(F.col(k), F.lit(0)) + SMOOTH) / F.col(f"below_{k}"))).alias(k.lower())

    each = words.select("word").distinct().filter(F.length("word") > 0).select("word", F.explode(grams_of(F.col("word"))).alias("gram"))
    scored = each.join(F.broadcast(wide), "gram", "left").crossJoin(F.broadcast(sums)).groupBy("word").agg(mean("Japanese"), mean("English"))
    return words.join(scored, "word", "left").withColumns({k: F.coalesce(k, F.lit(NO_LETTERS)) for k in ("japanese", "english")})


def leans(profile_words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, lean) of the profile's grams: the log-likelihood in Japanese less that in English; and one row (unseen), that of any other."""
    grams = profile(profile_words)
    of = {k: F.coalesce(F.sum(F.when(F.col("language") == k, F.col("n"))), F.lit(0)) for k in ("Japanese", "English")}
    below = totals(grams).agg(*(F.max(F.when(F.col("language") == k, F.col("total") + SMOOTH * F.col("vocabulary"))).alias(f"below_{k}") for k in of))
    lean = lambda ja, en: F.log((ja + SMOOTH) / F.col("below_Japanese")) - F.log((en + SMOOTH) / F.col("below_English"))
    seen = grams.groupBy("gram").agg(*(n.alias(k) for k, n in of.items())).crossJoin(F.broadcast(below))
    return seen.select("gram", lean(F.col("Japanese"), F.col("English")).alias("lean")), below.select(lean(F.lit(0), F.lit(0)).alias("unseen"))


def place_leans(texts: DataFrame, profile_words: DataFrame, word: str = "text", keys: tuple[str, ...] = ("text",)) -> DataFrame:
    """(keys, leans) of words, each on the one row of its keys: what each place adds to the lean of a span. Empty words have no row.

    pair, triple: the grams that begin there; head: those of a span of two or more that starts there; tail: that ends with it;
    alone: those of the place by itself. So a span's lean is a sum over its places, and no span meets the profile.
    """
    seen, unseen = leans(profile_words)
    places = texts.select(*dict.fromkeys((*keys, word))).filter(F.length(word) > 0).withColumn("at", F.explode(F.sequence(F.lit(0), F.length(word) - 1)))
    cut = lambda n, before=0: F.substr(word, F.col("at") + (1 - before), F.lit(n))
    begin, end = F.lit("^"), F.lit("$")
    grams = {"pair": cut(2), "triple": cut(3), "h2": F.concat(begin, cut(1)), "h3": F.concat(begin, cut(2)), "t2": F.concat(cut(1), end), "t3": F.concat(F.when(F.col("at") > 0, cut(2, 1)).otherwise(""), end), "one": F.concat(begin, cut(1), end)}
    for name, gram in grams.items():
        places = places.withColumn("gram", gram).join(F.broadcast(seen.withColumnRenamed("lean", name)), "gram", "left").drop("gram")
    places = places.crossJoin(F.broadcast(unseen))
    g = {name: F.coalesce(name, "unseen") for name in grams}
    parts = {"pair": g["pair"], "triple": g["triple"], "head": g["h2"] + g["h3"], "tail": g["t2"] + g["t3"], "alone": g["h2"] + g["t2"] + g["one"]}
    # a word's places come together as one list, in the order of the first field
    return places.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", *(c.alias(k) for k, c in parts.items())))).alias("leans"))


def span_lean(places: Column, n: Column) -> Column:
    """Mean lean over the grams of the span of the first n of some places (of place_leans)."""
    def over(k: int, name: str) -> Column:
        return F.aggregate(F.slice(places, F.lit(1), F.greatest(n - k, F.lit(0))), F.lit(0.0), lambda s, x: s + x[name])

    longer = F.get(places, F.lit(0))["head"] + over(1, "pair") + over(2, "triple") + F.get(places, n - 1)["tail"]
    return F.when(n == 1, F.get(places, F.lit(0))["alone"]).otherwise(longer) / (2 * n + 1)


def advantage(own: Column, other: Column) -> Column:
    return F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), own - other))
