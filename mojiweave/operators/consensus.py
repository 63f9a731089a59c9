"""Consensus of views on boundaries and readings, for every prefix of a text.

Only the beam and the two-way scores are sequential, and all prefixes of a text share them;
probabilities, the views, their agreement, the choice and the temporal windows are DataFrame operations
over (text, step). Hypotheses and views on boundaries are written once, as several results read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mojiweave.operators.dictionary import boundary_support
from mojiweave.operators.lattice import _map_texts
from mojiweave.plans import consensus as C
from mojiweave.sources import scratch

SEGMENT = "struct<start:int,end:int,raw:string,converted:string,language:string,complete:boolean,evidence:string,lexical_score:double>"
NAMES = ("start", "end", "raw", "converted", "language", "complete", "evidence", "lexical_score")


@dataclass(frozen=True)
class ConsensusParameters:
    beam: int = 64
    boundary: float = 0.68
    reading: float = 0.68
    vote: float = 0.67
    least_support: int = 2
    window: int = 4
    temperature: float = 1.30


def hypotheses(texts: DataFrame, p: ConsensusParameters) -> DataFrame:
    """(text, step, hypothesis, score, segments, probability) of every prefix of each distinct text of letters."""

    def work(text: str) -> Iterator[dict]:
        for step, found in enumerate(C.beams(text, p.beam), 1):
            for k, (score, path) in enumerate(found):
                yield {"step": step, "hypothesis": k, "score": score, "segments": [dict(zip(NAMES, s, strict=True)) for s in path]}

    rows = _map_texts(texts, f"step int, hypothesis int, score double, segments array<{SEGMENT}>", work)
    own = Window.partitionBy("text", "step")
    weight = F.exp((F.col("score") - F.max("score").over(own)) / p.temperature)
    return rows.withColumn("_w", weight).withColumn("probability", F.col("_w") / F.sum("_w").over(own)).drop("_w")


def two_way(texts: DataFrame) -> DataFrame:
    """(text, step, position, reverse)."""

    def work(text: str) -> Iterator[dict]:
        for step, worth in enumerate(C.throughs(text), 1):
            for i, x in enumerate(worth, 1):
                yield {"step": step, "position": i, "reverse": x}

    return _map_texts(texts, "step int, position int, reverse double", work)


def _mean(*views: Column) -> Column:
    held = F.array_compact(F.array(*views))
    return F.aggregate(held, F.lit(0.0), lambda s, v: s + v) / F.size(held)


def _support(p: ConsensusParameters, *views: Column) -> Column:
    return F.size(F.filter(F.array_compact(F.array(*views)), lambda v: v >= p.vote))


def boundaries(hyps: DataFrame, texts: DataFrame, lexicon: DataFrame, p: ConsensusParameters) -> DataFrame:
    """(text, step, position, probability, beam, reverse, lexical, stability, support, confirmed, is_end); stability is null before two observations."""
    ends = hyps.select("text", "step", "probability", F.explode(F.array_distinct(F.transform("segments", lambda s: s["end"]))).alias("position"))
    mass = ends.groupBy("text", "step", "position").agg(F.sum("probability").alias("beam"))
    ways = two_way(texts)
    prefixes = ways.select("text", "step").distinct().withColumn("prefix", F.substr("text", F.lit(1), F.col("step")))
    lexical = boundary_support(prefixes.select(F.col("prefix").alias("text")), lexicon).withColumnsRenamed({"text": "prefix", "support": "lexical"})
    rows = ways.withColumn("prefix", F.substr("text", F.lit(1), F.col("step"))).join(lexical, ["prefix", "position"]).drop("prefix")
    rows = rows.join(mass, ["text", "step", "position"], "left").withColumn("beam", F.coalesce("beam", F.lit(0.0))).withColumn("is_end", F.col("step") == F.col("position"))
    # frames whose prefix goes beyond the place, the last few before this one
    seen = Window.partitionBy("text", "position", "is_end").orderBy("step").rowsBetween(-p.window, -1)
    earlier = F.when(~F.col("is_end") & (F.count(F.lit(1)).over(seen) >= 2), F.avg("beam").over(seen))
    rows = rows.withColumn("stability", earlier)
    views = [F.col(c) for c in ("beam", "reverse", "lexical", "stability")]
    rows = rows.withColumn("probability", _mean(*views)).withColumn("support", _support(p, *views))
    confirmed = ~F.col("is_end") & (F.col("probability") >= p.boundary) & (F.col("support") >= p.least_support)
    return rows.withColumn("confirmed", confirmed).select("text", "step", "position", "probability", "beam", "reverse", "lexical", "stability", "support", "confirmed", "is_end")


def _evidence_support(evidence: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in C.SUPPORT.items() for x in kv)), evidence), F.lit(0.20))


def ranked(hyps: DataFrame, bounds: DataFrame) -> DataFrame:
    """hyps with boundary_agreement, lexical_agreement, ensemble and rank."""
    inner = hyps.select("text", "step", "hypothesis", F.explode(F.transform("segments", lambda s: s["end"])).alias("position")).filter("position < step")
    agreed = inner.join(bounds.select("text", "step", "position", "probability"), ["text", "step", "position"]).groupBy("text", "step", "hypothesis").agg(F.avg("probability").alias("boundary_agreement"))
    lexical = F.aggregate("segments", F.lit(0.0), lambda a, s: a + _evidence_support(s["evidence"])) / F.size("segments")
    unknown = F.size(F.filter("segments", lambda s: s["language"] == "Unknown"))
    out = hyps.join(agreed, ["text", "step", "hypothesis"], "left").withColumn("boundary_agreement", F.coalesce("boundary_agreement", F.lit(0.5))).withColumn("lexical_agreement", lexical)
    out = out.withColumn("ensemble", F.log(F.greatest(F.col("probability"), F.lit(1e-12))) + 1.45 * F.col("boundary_agreement") + 0.90 * F.col("lexical_agreement") - 0.55 * unknown)
    # what differs in the last bits only is equal
    order = Window.partitionBy("text", "step").orderBy(F.desc(F.round("ensemble", 9)), F.desc(F.round("probability", 9)), "hypothesis")
    return out.withColumn("rank", F.row_number().over(order))


def frames(rank: DataFrame) -> DataFrame:
    """(text, step, segmentation, output, probability, ensemble, entropy, n_hypotheses)."""
    own = rank.groupBy("text", "step").agg(F.sum(F.when(F.col("probability") > 0, -F.col("probability") * F.log2("probability"))).alias("entropy"), F.count(F.lit(1)).alias("n_hypotheses"))
    best = rank.filter("rank = 1").select("text", "step", F.array_join(F.transform("segments", lambda s: s["raw"]), " | ").alias("segmentation"), F.array_join(F.transform("segments", lambda s: s["converted"]), "").alias("output"), "probability", "ensemble")
    return best.join(own, ["text", "step"])


def segments(rank: DataFrame, bounds: DataFrame, p: ConsensusParameters) -> DataFrame:
    """The chosen segments of each frame with their views, support and certainty."""
    key = ["text", "step", "start", "end", "language", "converted"]
    parts = rank.select("text", "step", "hypothesis", "rank", "probability", F.inline("segments"))
    mass = parts.dropDuplicates([*key, "hypothesis"]).groupBy(*key).agg(F.sum("probability").alias("beam"))
    chosen = parts.filter("rank = 1").drop("hypothesis", "rank", "probability").join(mass, key)
    before = Window.partitionBy("text", "start", "end", "raw", "converted", "language").orderBy("step").rangeBetween(-p.window, -1)
    n = F.least(F.lit(p.window), F.col("step") - 1 - F.col("end"))
    chosen = chosen.withColumn("_same", F.count_if(F.col("step") > F.col("end")).over(before)).withColumn("stability", F.when(n >= 2, F.col("_same") / n)).drop("_same")
    views = [F.col("beam"), _evidence_support(F.col("evidence")), F.col("stability")]
    chosen = chosen.withColumn("lexical", views[1]).withColumn("interpretation", _mean(*views)).withColumn("support", _support(p, *views))
    b = bounds.select("text", "step", F.col("position").alias("end"), F.col("probability").alias("boundary"), (~F.col("is_end") & F.col("confirmed")).alias("boundary_clear"))
    out = chosen.join(b, ["text", "step", "end"]).withColumn("clear", (F.col("interpretation") >= p.reading) & (F.col("support") >= p.least_support))
    certainty = F.concat(F.when(F.col("boundary_clear"), "ClearBoundary").otherwise("AmbiguousBoundary"), F.when(F.col("clear"), "ClearInterpretation").otherwise("AmbiguousInterpretation"))
    return out.select("text", "step", "start", "end", "raw", "converted", "language", "complete", (F.col("complete") & F.col("boundary_clear") & F.col("clear")).alias("confirmed"), "boundary", "beam", "lexical", F.coalesce("stability", F.lit(-1.0)).alias("stability"), "interpretation", "support", certainty.alias("certainty"))


def analyze(texts: DataFrame, lexicon: DataFrame, p: ConsensusParameters | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, boundaries, segments) of the distinct texts, letters only."""
    p = p or ConsensusParameters()
    texts = texts.select("text").filter(F.col("text").rlike("^[a-z]+$")).distinct()
    hyps = scratch.written(hypotheses(texts, p))
    bounds = scratch.written(boundaries(hyps, texts, lexicon, p))
    rank = ranked(hyps, bounds)
    return frames(rank), bounds, segments(rank, bounds, p)
