"""Romaji to kana, as Column functions: one regex cuts a text into units, higher-order functions do the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mojiweave.sources.fixed import BINDING, HARD, KANA, NEUTRAL, PREFIXES

_KEYS = "|".join(sorted(KANA, key=lambda k: (-len(k), k)))
#: A doubled consonant's first, nn, n that starts no syllable, or a syllable.
TOKEN = rf"([bcdfghjklmpqrstvwxyz])(?=\1)|nn|n(?![aiueoy])|(?:{_KEYS})"
#: A token, what may become one at the end, or any character.
UNIT = rf"{TOKEN}|(?:{'|'.join(PREFIXES)})\z|(?s:.)"
SYMBOLS = BINDING + HARD + NEUTRAL + " "


def _kana_map() -> Column:
    return F.create_map(*(F.lit(x) for pair in {**KANA, "nn": "ん", "n": "ん"}.items() for x in pair))


def units(text: Column) -> Column:
    """array<struct<start, end, raw, preview, kind, confidence>> of a normalised text."""
    tokens = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    following = F.slice(F.concat(tokens, F.array(F.lit(None).cast("string"))), F.lit(2), F.size(tokens))
    # where each token ends; lambdas below see their own element only, so the text is cut into tokens outside of them
    ends = F.aggregate(tokens, F.array().cast("array<int>"), lambda a, t: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(t)))
    known, open_ = _kana_map(), F.array(*(F.lit(p) for p in PREFIXES))

    def unit(x: Column) -> Column:
        t, after, end = x["raw"], x["after"], x["end"]
        double = t.rlike("^[b-df-hj-mp-tv-z]$") & F.coalesce(F.startswith(after, t), F.lit(False))
        stray = (t == "n") & F.coalesce(F.startswith(after, F.lit("y")), F.lit(False))  # ny without its vowel
        kana = F.when(double, "っ").when(~stray, F.try_element_at(known, t))
        symbol, is_open = ~t.rlike("^[a-z]"), after.isNull() & F.array_contains(open_, t)
        kind = F.when(symbol, "Symbol").when(kana.isNotNull(), "Kana").when(is_open, "Ambiguous").otherwise("Pending")
        shown = F.when(symbol, t).when(kana.isNotNull(), kana).when(is_open, F.concat(F.lit("{"), t, F.lit("…}"))).otherwise(F.concat(F.lit("{"), t, F.lit("?}")))
        sure = F.when(symbol, F.when(t.isin(*SYMBOLS), 1.0).otherwise(0.65)).when(kana.isNotNull(), 1.0).when(is_open, 0.35).otherwise(0.05)
        return F.struct((end - F.length(t)).alias("start"), end.alias("end"), t.alias("raw"), shown.alias("preview"), kind.alias("kind"), sure.cast("double").alias("confidence"))

    return F.transform(F.arrays_zip(tokens.alias("raw"), following.alias("after"), ends.alias("end")), unit)


def preview(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda u: u["preview"]), "")


def preview_range(found: Column, start: Column, end: Column) -> Column:
    """The preview of the units that lie wholly in [start, end)."""
    return preview(F.filter(found, lambda u: (u["start"] >= start) & (u["end"] <= end)))


def converts(text: Column) -> Column:
    """Whether all of a text reads as kana: one regex that never goes back on a token."""
    return text.rlike(rf"^(?>{TOKEN})++\z")


def kana(text: Column) -> Column:
    """The whole text in kana, null unless it converts; an empty text is null too."""
    tokens, known = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), _kana_map()
    return F.when(converts(text), F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[b-df-hj-mp-tv-z]$"), "っ").otherwise(F.try_element_at(known, t))), ""))


def leading(text: Column) -> Column:
    """The tokens that a text begins with, up to what none takes."""
    return F.regexp_extract_all(F.regexp_extract(text, rf"^(?>{TOKEN})*+", 0), F.lit(TOKEN), F.lit(0))


def doubles(token: Column) -> Column:
    """Whether a token is a doubled consonant's first half."""
    return token.rlike("^[b-df-hj-mp-tv-z]$")


def said(tokens: Column) -> Column:
    """The kana of each token."""
    known = _kana_map()
    return F.transform(tokens, lambda t: F.when(doubles(t), "っ").otherwise(F.try_element_at(known, t)))


def beginnings(text: Column, tokens: Column, shown: Column, k: Column) -> Column:
    """array<struct<n, kana>>: the beginnings of a text that convert and end after k of its leading tokens, or after an n more; null elements for those that do not.

    No syllable begins another, so a beginning is cut into tokens as the whole is; only an n at its end stands for itself
    there, and a doubled consonant has its second half or is none. All arguments are columns of the table, or they are made anew for each k.
    """
    n, now = F.length(F.array_join(F.slice(tokens, F.lit(1), k), "")), F.array_join(F.slice(shown, F.lit(1), k), "")
    whole = (k > 0) & ~F.coalesce(doubles(F.get(tokens, k - 1)), F.lit(False))
    more = (F.substr(text, n + 1, F.lit(1)) == "n") & F.coalesce(F.get(tokens, k) != "n", F.lit(True))
    return F.array(F.when(whole, F.struct(n.alias("n"), now.alias("kana"))), F.when(more, F.struct((n + 1).alias("n"), F.concat(now, F.lit("ん")).alias("kana"))))


def _letters(found: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(F.filter(found, lambda u: u["kind"].isin(*kinds)), F.lit(0), lambda n, u: n + F.length(u["raw"])).cast("double")


def coverage(text: Column, found: Column) -> Column:
    """struct<kana_coverage, ambiguous_coverage, unresolved_ratio>, shares of the letters; an empty text is all kana."""
    total = _letters(found, ("Kana", "Ambiguous", "Pending"))
    kana_share, open_share = (F.coalesce(F.try_divide(_letters(found, (k,)), total), F.lit(0.0)) for k in ("Kana", "Ambiguous"))
    none, empty = F.lit(0.0), F.length(text) == 0
    return F.struct(
        F.when(empty, 1.0).otherwise(kana_share).alias("kana_coverage"),
        F.when(empty, none).otherwise(open_share).alias("ambiguous_coverage"),
        F.when(total == 0, none).otherwise(F.least(F.greatest(1.0 - kana_share - 0.35 * open_share, none), F.lit(1.0))).alias("unresolved_ratio"),
    )


def unresolved(text: Column) -> Column:
    """coverage()'s unresolved_ratio without the units: what no token takes stays, and what may become one at the end is a suffix of that."""
    letters = lambda c: F.length(F.regexp_replace(c, "[^a-z]", "")).cast("double")
    rest = F.regexp_replace(text, TOKEN, "_")
    open_ = F.length(F.regexp_extract(rest, rf"(?:{'|'.join(PREFIXES)})\z", 0)).cast("double")
    total, left = letters(text), letters(rest)
    share = F.coalesce(F.try_divide(total - left, total), F.lit(0.0)), F.coalesce(F.try_divide(open_, total), F.lit(0.0))
    return F.when(total == 0, 0.0).otherwise(F.least(F.greatest(1.0 - share[0] - 0.35 * share[1], F.lit(0.0)), F.lit(1.0)))


def readability(found: Column, start: Column, end: Column) -> Column:
    """Mean confidence over the characters of [start, end), symbols left out; 0 if nothing is left."""
    def overlap(u: Column) -> Column:
        return F.greatest(F.lit(0), F.least(u["end"], end) - F.greatest(u["start"], start)).cast("double")

    real = F.filter(found, lambda u: u["kind"] != "Symbol")
    weight = F.aggregate(real, F.lit(0.0), lambda s, u: s + overlap(u))
    total = F.aggregate(real, F.lit(0.0), lambda s, u: s + overlap(u) * u["confidence"])
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))
