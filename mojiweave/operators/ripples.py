"""What is odd in a stretch of text, and what it shakes: unions, and band joins of segments with oddities.

A session tells the places from which it read its input at each keystroke; every distinct stretch is
then read once, whatever texts and keystrokes it stands in.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiweave.operators.intervals import band_join
from mojiweave.operators.lattice import _map_texts
from mojiweave.operators.orthography import symbol_evidence
from mojiweave.operators.phonetic_sessions import RIPPLE, resolved, uncovered
from mojiweave.plans import phonetic_first as P

ANCHORED = "stage2-orthographic-latin-token"


def reads(texts: DataFrame, p: P.PhoneticParameters | None = None) -> DataFrame:
    """(text, step, base, place, probes): the stretches that each keystroke of a text (of allowed characters in lower case) shook, from base to step; probes with the first of a step."""
    p = p or P.PhoneticParameters()
    names = [x.split(":")[0] for x in RIPPLE[len("struct<") : -1].split(",")]

    def work(text: str) -> Iterator[dict]:
        session = P.PhoneticSession(p)
        for step, c in enumerate(text, 1):
            bases: list[int] = []
            session._key(c, bases.append)
            probes = [dict(zip(names, (*r[:4], *r.affected, r.reason), strict=True)) for r in session._ripples]
            yield from ({"step": step, "base": b, "place": k, "probes": [] if k else probes} for k, b in enumerate(bases))

    return _map_texts(texts, f"step int, base int, place int, probes array<{RIPPLE}>", work)


def oddities(texts: DataFrame, segments: DataFrame, p: P.PhoneticParameters | None = None) -> DataFrame:
    """(text, source_start, source_end, source_kind, strength, source_reason) of each distinct text; segments: as resolved() gives them."""
    p = p or P.PhoneticParameters()
    n = F.length("text")

    def rows(df: DataFrame, kind: str, strength, reason) -> DataFrame:
        return df.select("text", F.col("start").alias("source_start"), F.col("end").alias("source_end"), F.lit(kind).alias("source_kind"), strength.alias("strength"), reason.alias("source_reason"))

    open_ = uncovered(texts, p)
    plain = segments.filter(~F.col("reason").contains("symbol"))
    pending = rows(open_.filter("kind = 'Pending'"), "PendingPhonetic", F.when(F.col("end") == n, 0.35).otherwise(1.0), F.lit("not-readable-as-romaji-here"))
    inner = rows(open_.filter((F.col("kind") == "Ambiguous") & (F.col("end") < n)), "InteriorAmbiguity", F.lit(0.55), F.lit("incomplete-romaji-prefix"))
    unknown = rows(plain.filter("language = 'Unknown'"), "UnknownSegment", F.lit(1.0), F.col("reason"))
    gap = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(p.low_confidence) - F.col("confidence")) / max(p.low_confidence, 0.0001)))
    weak = plain.filter((F.col("language") != "Unknown") & (F.col("confidence") < p.low_confidence) & (n - F.col("end") >= p.lookahead))
    weak = rows(weak, "LowConfidenceSegment", F.greatest(F.lit(p.trigger), F.least(F.lit(1.0), p.trigger + gap * (1.0 - p.trigger))), F.format_string("%s;confidence=%.3f", "reason", "confidence"))
    waiting = rows(symbol_evidence(texts).filter("kind = 'IncompleteBindingToken'"), "IncompleteBindingToken", F.lit(0.95), F.col("reason"))
    return pending.unionByName(inner).unionByName(unknown).unionByName(weak).unionByName(waiting)


def waves(texts: DataFrame, p: P.PhoneticParameters | None = None) -> DataFrame:
    """(text, start, end, raw, output, language, confidence, reason; source_start ... source_reason, distance): each segment of each distinct text with what is odd near it."""
    p = p or P.PhoneticParameters()
    segments = resolved(texts, p)
    return band_join(segments, oddities(texts, segments, p), ["text"], p.radius)


def shaken(texts: DataFrame, p: P.PhoneticParameters | None = None) -> DataFrame:
    """The segments of each distinct text with context_penalty, and confidence less what is odd near them takes away."""
    p = p or P.PhoneticParameters()
    take = F.least(F.lit(0.70), F.col("strength") * F.pow(F.lit(p.decay), F.col("distance")))
    penalty = waves(texts, p).groupBy("text", "start", "end").agg(F.max(take).alias("_p"))
    loose = F.when(F.col("reason") != ANCHORED, F.coalesce("_p", F.lit(0.0))).otherwise(F.lit(0.0))
    out = resolved(texts, p).join(penalty, ["text", "start", "end"], "left").withColumn("context_penalty", loose).drop("_p")
    return out.withColumn("confidence", F.when(F.col("context_penalty") > 0, F.col("confidence") * (1.0 - F.col("context_penalty"))).otherwise(F.col("confidence")))


def stretches(read: DataFrame) -> DataFrame:
    """read (text, step, base, ...) with stretch, the characters from base to step."""
    return read.withColumn("stretch", F.substr("text", F.col("base") + 1, F.col("step") - F.col("base")))


def ripple_events(read: DataFrame, p: P.PhoneticParameters | None = None) -> DataFrame:
    """(text, step, source_start, ..., reason) of what read (as reads() gives it; a written table) tells: what the probes found, and what shook each stretch."""
    p = p or P.PhoneticParameters()
    told = stretches(read)
    found = waves(told.select(F.col("stretch").alias("text")).distinct(), p).withColumnRenamed("text", "stretch")
    base = F.col("base")
    each = told.join(found, "stretch").select(
        "text", "step", (base + F.col("source_start")).alias("source_start"), (base + F.col("source_end")).alias("source_end"), "source_kind", "strength",
        (base + F.col("start")).alias("affected_start"), (base + F.col("end")).alias("affected_end"), F.concat("source_reason", F.lit(";distance="), "distance").alias("reason"),
    )
    return each.unionByName(read.select("text", "step", F.inline("probes")))
