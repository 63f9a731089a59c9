"""Character classes and normal form of keystroke text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mojiweave.sources.fixed import BINDING, HARD, NEUTRAL

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def char_set(chars: str) -> str:
    """The characters as the inside of a regex class, good for Java and RE2."""
    return "".join("\\" + c if c in "\\]^-[/.+#\"'(){}?" else c for c in chars)


ALLOWED = "A-Za-z0-9 " + char_set(BINDING + HARD + NEUTRAL)


def normalize(text: Column) -> Column:
    """A-Z lower-cased, nothing else; keeps the length."""
    return F.translate(text, UPPER, LOWER)


def is_allowed(text: Column) -> Column:
    return ~text.rlike(f"[^{ALLOWED}]")


def is_letters(text: Column) -> Column:
    """The older recogniser takes ASCII letters only."""
    return ~text.rlike("[^A-Za-z]")


def lenient(text: Column) -> Column:
    """Characters that are not allowed dropped, then normalised: what an editor lets through."""
    return normalize(F.regexp_replace(text, f"[^{ALLOWED}]", ""))


def strict(text: Column) -> Column:
    """Normalised; a character that is not allowed ends the query."""
    return F.when(is_allowed(text), normalize(text)).otherwise(F.raise_error(F.lit("input has a character that is not allowed")))


def quarantine(rows: DataFrame, column: str) -> DataFrame:
    """rows with text (normalised, null where a character is not allowed), rejected (the first such character) and rejected_at: bad rows stay beside good ones and end nothing."""
    bad = F.regexp_extract(column, f"[^{ALLOWED}]", 0)
    rejected = F.when(F.length(bad) > 0, bad)
    return rows.withColumn("text", F.when(rejected.isNull(), normalize(F.col(column)))).withColumn("rejected", rejected).withColumn("rejected_at", F.when(rejected.isNotNull(), F.instr(column, rejected) - 1))


def char_class(c: Column) -> Column:
    """word, binding, hard (a space too), neutral or other, of a single character."""
    return (
        F.when(c.rlike("^[A-Za-z0-9]$"), "word")
        .when(c.isin(*BINDING), "binding")
        .when(c.isin(*HARD, " "), "hard")
        .when(c.isin(*NEUTRAL), "neutral")
        .otherwise("other")
    )


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")
