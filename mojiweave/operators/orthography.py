"""Orthographic evidence: symbols and tokens that binding symbols hold together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mojiweave.functions import phonetic
from mojiweave.operators.dictionary import strong_boundaries
from mojiweave.operators.intervals import stab_join
from mojiweave.plans import reading as R
from mojiweave.sources.fixed import BINDING, HARD, NEUTRAL
from mojiweave.sources.tables import lexicon as entries

#: Confidence, completeness and reason of each kind.
TOLD = {
    "HardBoundary": (0.99, True, "hard-boundary-symbol"),
    "NeutralSymbol": (0.70, True, "neutral-symbol"),
    "LatinBindingToken": (0.97, True, "binding-symbol-joins-latin-token"),
    "IncompleteBindingToken": (0.72, False, "binding-symbol-awaiting-right-context"),
    "BindingSymbol": (0.55, False, "binding-symbol-without-complete-token"),
}
_TOKEN = R.WORD | R.BINDERS
_SUFFIXES = ("japanese-particle", "japanese-verb-suffix", "japanese-auxiliary", "japanese-verb")


def _suffix_cut(text: str, first: int, end: int) -> int:
    """Where a Japanese suffix begins inside [first, end), else end: the leftmost cut with letters on both sides, a strong entry after it and a left side that romaji does not read."""
    for cut in range(first + 1, end):
        if not any(e.language == "Japanese" and e.weight >= 5.1 and (e.evidence in _SUFFIXES or len(e.raw) >= 3) for e in R.entries_at(text, cut)):
            continue
        tail, left = text[cut:end], text[first:cut]
        if all(c in R.LETTERS for c in tail) and any(c in R.LETTERS for c in left) and R.unresolved(left) >= 0.20:
            return cut
    return end


def evidence(text: str) -> list[tuple]:
    """(start, end, raw, kind, confidence, complete, reason) of a text, in order; a token inside one kept before is left out."""
    found, n = [], len(text)
    for i, c in enumerate(text):
        if c in R.BREAKS:
            found.append((i, i + 1, "HardBoundary", 0.99, True, "hard-boundary-symbol"))
        elif c in R.NEUTRALS:
            found.append((i, i + 1, "NeutralSymbol", 0.70, True, "neutral-symbol"))
        elif c in R.BINDERS:
            left = i > 0 and text[i - 1] in R.WORD
            right = i + 1 < n and text[i + 1] in R.WORD
            start = i
            while left and start > 0 and text[start - 1] in _TOKEN:
                start -= 1
            if left and (right or c in "#+"):
                end = i + 1
                while end < n and text[end] in (_TOKEN if right else "#+"):
                    end += 1
                if right:
                    end = _suffix_cut(text, i + 1, end)
                found.append((start, end, "LatinBindingToken", 0.97, True, "binding-symbol-joins-latin-token"))
            elif left and i == n - 1:
                found.append((start, n, "IncompleteBindingToken", 0.72, False, "binding-symbol-awaiting-right-context"))
            else:
                found.append((i, i + 1, "BindingSymbol", 0.55, False, "binding-symbol-without-complete-token"))
    out: list[tuple] = []
    for f in sorted(found, key=lambda f: (f[0], -f[1])):
        if f[2] == "LatinBindingToken" and any(o[2] == f[2] and o[0] <= f[0] and f[1] <= o[1] for o in out):
            continue
        out.append(f)
    return [(a, b, text[a:b], *rest) for a, b, *rest in out]


_RUN = "[" + "".join(sorted(R.WORD)) + r"._\-+#@/:]"


def marks(texts: DataFrame) -> DataFrame:
    """(text, at, c, start, after, reach, token, waiting) of each symbol of each text: the run of word and binding characters that ends before it, whether a word character follows, how far a token goes, and whether it is one or may become one."""
    symbols = [*BINDING, *HARD, *NEUTRAL, " "]
    each = texts.select("text", F.posexplode(F.split("text", "")).alias("at", "c")).filter(F.col("c").isin(*symbols))
    before, rest = F.substr("text", F.lit(1), F.col("at")), F.substr("text", F.col("at") + 2, F.length("text"))
    binder, left, right = F.col("c").isin(*BINDING), before.rlike("[a-z0-9]$"), rest.rlike("^[a-z0-9]")
    run = F.length(F.regexp_extract(before, f"{_RUN}*$", 0))
    reach = F.length(F.when(right, F.regexp_extract(rest, f"^{_RUN}*", 0)).otherwise(F.regexp_extract(rest, "^[#+]*", 0)))
    return each.select(
        "text", "at", "c", F.when(binder & left, F.col("at") - run).otherwise(F.col("at")).alias("start"), right.alias("after"), (F.col("at") + 1 + reach).alias("reach"),
        (binder & left & (right | F.col("c").isin("#", "+"))).alias("token"), (binder & left & (F.col("at") == F.length("text") - 1)).alias("waiting"),
    )


def is_cut(own: Column, tail: Column) -> Column:
    """Whether a suffix begins between what a token has after its symbol and its tail: letters on both sides, the left ones not read by romaji."""
    return tail.rlike("^[a-z]+$") & own.rlike("[a-z]") & (phonetic.unresolved(own) >= 0.20)


def _cuts(texts: DataFrame, marks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(text, at, cut) of the tokens in which a Japanese suffix begins: the leftmost strong entry with letters only up to the token's end, after letters that romaji does not read."""
    strong = strong_boundaries(texts, lexicon).filter("side = 'after'").select("text", F.col("position").alias("point"))
    inside = stab_join(marks.filter("token and after").select("text", "at", (F.col("at") + 1).alias("start"), F.col("reach").alias("end")), strong, ["text"])
    own, tail = F.substr("text", F.col("start") + 1, F.col("point") - F.col("start")), F.substr("text", F.col("point") + 1, F.col("end") - F.col("point"))
    found = inside.withColumn("own", own).withColumn("tail", tail).filter(is_cut(F.col("own"), F.col("tail")))
    return found.groupBy("text", "at").agg(F.min("point").alias("cut"))


def symbol_evidence(texts: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Evidence rows of each distinct text, as evidence() gives them: a scan of symbols, a join with strong entries for suffixes, and a running maximum of ends that leaves out tokens inside others."""
    texts = texts.select("text").filter("text is not null").distinct()
    found = marks(texts)
    cuts = _cuts(texts, found, lexicon if lexicon is not None else entries(texts.sparkSession))
    known = found.join(cuts, ["text", "at"], "left").withColumn("end", F.when(F.col("token"), F.coalesce("cut", "reach")).otherwise(F.col("at") + 1))
    earlier = Window.partitionBy("text", "token").orderBy("start", F.desc("end"), "at").rowsBetween(Window.unboundedPreceding, -1)
    kept = known.withColumn("_far", F.max("end").over(earlier)).filter(~F.col("token") | F.col("_far").isNull() | (F.col("_far") < F.col("end")))
    c, waits = F.col("c"), F.col("waiting") & ~F.col("token")
    kind = F.when(c.isin(*HARD, " "), "HardBoundary").when(c.isin(*NEUTRAL), "NeutralSymbol").when(F.col("token"), "LatinBindingToken").when(waits, "IncompleteBindingToken").otherwise("BindingSymbol")
    kept = kept.withColumn("kind", kind).withColumn("start", F.when(F.col("token") | waits, F.col("start")).otherwise(F.col("at")))
    told = F.create_map(*(F.lit(x) for k, v in TOLD.items() for x in (k, F.struct(*(F.lit(y) for y in v)))))[F.col("kind")]
    return kept.select("text", "start", "end", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("raw"), "kind", told["col1"].alias("confidence"), told["col2"].alias("complete"), told["col3"].alias("reason"))


def binding_runs(texts: DataFrame) -> DataFrame:
    """(text, place, run) of the runs of word and binding characters that hold a binding character: a scan without Python."""
    runs = F.filter(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._\-+#@/:]+"), F.lit(0)), lambda r: r.rlike(r"[._\-+#@/:]"))
    return texts.select("text", F.posexplode(runs).alias("place", "run"))
