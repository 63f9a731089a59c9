"""Whole sessions as documents: a row per text with its parameters, result and every frame, ready for export.as_document().

A document holds a text's whole session, so a row is as large as that; texts do not meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mojiweave.operators import consensus, lattice, phonetic_sessions
from mojiweave.plans import phonetic_first as P
from mojiweave.sources.export import as_document
from mojiweave.sources.fixed import LatticeParameters

LATTICE_FORMAT, LATTICE_VERSION = "evidence-lattice-v1", "evidence-lattice"
PHONETIC_FORMAT, PHONETIC_VERSION = "phonetic-first-rcr-v2", "phonetic-first"
CONSENSUS_FORMAT, CONSENSUS_VERSION = "research-v2", "consensus"

# --- fixed values: keys of the three formats that differ from the names used here ---
LATTICE_KEYS = {
    "beam": "beamWidth", "phonetic_span": "maxPhoneticSpan", "latin_side": "maxLatinSide", "consensus_paths": "consensusPathCount",
    "score_window": "alternativeScoreWindow", "lookahead": "commitLookahead", "stable_frames": "commitStabilityFrames", "switch_penalty": "languageSwitchPenalty",
}
PHONETIC_KEYS = {
    "lookahead": "minimumLookaheadToFreeze", "longest_fallback": "maximumJapaneseFallbackLength", "english_anomaly": "englishAnomalyThreshold",
    "freeze": "freezeConfidenceThreshold", "low_confidence": "lowConfidenceRippleThreshold", "hard_lookahead": "hardFreezeLookahead",
    "segment_radius": "rippleSegmentRadius", "radius": "rippleCharacterRadius", "decay": "rippleDecay", "trigger": "rippleTriggerThreshold",
    "frames.segments": "activeSegments", "frames.frozen": "frozenThisStep", "frames.analyzed": "analyzedCharactersThisStep", "frames.total_analyzed": "totalAnalyzedCharacters",
}
_SEGMENT_KEYS = {
    "boundary": "boundaryConfidence", "beam": "beamInterpretationConfidence", "lexical": "lexicalInterpretationConfidence",
    "stability": "stabilityInterpretationConfidence", "interpretation": "interpretationConfidence", "support": "independentSupport",
}
_BOUNDARY_KEYS = {
    "beam": "beamProbability", "reverse": "bidirectionalProbability", "lexical": "lexicalProbability", "stability": "stabilityProbability",
    "support": "independentSupport", "is_end": "isInputEnd",
}
CONSENSUS_KEYS = {
    "beam": "beamWidth", "boundary": "boundaryClearThreshold", "reading": "interpretationClearThreshold", "vote": "consensusVoteThreshold",
    "least_support": "minimumIndependentSupport", "window": "stabilityWindow", "temperature": "softmaxTemperature",
    "frames.segmentation": "bestSegmentation", "frames.output": "converted", "frames.probability": "bestHypothesisProbability",
    "frames.ensemble": "bestEnsembleScore", "frames.entropy": "entropyBits",
    **{f"{x}.{k}": v for x in ("segments", "final_segments") for k, v in _SEGMENT_KEYS.items()},
    **{f"{x}.{k}": v for x in ("boundaries", "final_boundaries") for k, v in _BOUNDARY_KEYS.items()},
}


def _document(rows: DataFrame, kind: str, version: str, p, keys: dict[str, str]) -> DataFrame:
    return as_document(rows, kind, version, {keys.get(k, k): v for k, v in asdict(p).items()}, "text", names=keys)


def _stamped(rows: DataFrame, at: Column | None) -> DataFrame:
    stamp = F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return rows.select("text", stamp.alias("generated_at_utc"), *(c for c in rows.columns if c != "text"))


def lattice_report(texts: DataFrame, p: LatticeParameters | None = None, at: Column | None = None, kind: str = LATTICE_FORMAT) -> DataFrame:
    """(text, json) of each distinct text, typed one key at a time; at: the time stamp, now if not given."""
    p = p or LatticeParameters()
    frames = lattice.session_frames(texts, p, nested=True)
    whole = frames.groupBy("text").agg(F.array_sort(F.collect_list(F.struct(*(c for c in frames.columns if c != "text")))).alias("frames"))
    last = F.element_at("frames", -1)
    base = last["committed_raw_length"]
    best = F.coalesce(F.get(last["top_paths"], 0)["edges"], F.array().cast(f"array<{lattice.EDGE}>"))
    active = F.transform(best, lambda e: e.withField("start", e["start"] + base).withField("end", e["end"] + base))
    rows = whole.select(
        "text", last["input"].alias("input"), last["output"].alias("output"), base.alias("committed_raw_length"),
        F.flatten(F.transform("frames", lambda f: f["commit_events"])).alias("committed_segments"), active.alias("active_best_segments"), "frames",
    )
    return _document(_stamped(rows, at), kind, LATTICE_VERSION, p, LATTICE_KEYS)


def phonetic_report(texts: DataFrame, p: P.PhoneticParameters | None = None, at: Column | None = None, kind: str = PHONETIC_FORMAT) -> DataFrame:
    """The same of phonetic-first sessions."""
    p = p or P.PhoneticParameters()
    names = phonetic_sessions.segment_names()

    def work(text: str) -> Iterator[dict]:
        session = P.PhoneticSession(p)
        steps = session.update(text)
        if steps:
            held = [dict(zip(names, x, strict=True)) for x in session.committed]
            frames = [phonetic_sessions.step_row(x) for x in steps]
            yield {"input": steps[-1].input, "output": steps[-1].output, "committed_raw_length": session.done, "committed_segments": held, "active_segments": frames[-1]["segments"], "frames": frames}

    schema = f"input string, output string, committed_raw_length int, committed_segments array<{phonetic_sessions.SEGMENT}>, active_segments array<{phonetic_sessions.SEGMENT}>, frames array<struct<{phonetic_sessions.step_fields()}>>"
    return _document(_stamped(lattice._map_texts(texts, schema, work), at), kind, PHONETIC_VERSION, p, PHONETIC_KEYS)


def consensus_report(texts: DataFrame, lexicon: DataFrame, p: consensus.ConsensusParameters | None = None, at: Column | None = None, kind: str = CONSENSUS_FORMAT) -> DataFrame:
    """The same of the consensus over prefixes: each frame with its segments and boundaries."""
    p = p or consensus.ConsensusParameters()
    frames, bounds, segments = consensus.analyze(texts, lexicon, p)

    def listed(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("text", "step").agg(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c not in ("text", "step"))))).alias(name))

    each = frames.withColumn("prefix", F.substr("text", F.lit(1), F.col("step"))).join(listed(segments, "segments"), ["text", "step"], "left").join(listed(bounds, "boundaries"), ["text", "step"], "left")
    inner = [c for c in each.columns if c not in ("text", "step")]
    whole = each.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("step", *inner))).alias("frames"))
    last = F.element_at("frames", -1)
    rows = whole.select("text", F.col("text").alias("input"), last["output"].alias("converted"), last["segments"].alias("final_segments"), last["boundaries"].alias("final_boundaries"), "frames")
    return _document(_stamped(rows, at), kind, CONSENSUS_VERSION, p, CONSENSUS_KEYS)
