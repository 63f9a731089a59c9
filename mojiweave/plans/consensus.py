"""The older recogniser's sequential parts: a beam over each prefix of a text, and the best score through each place of it.

What a prefix reads as up to a place before its end does not depend on where it ends: only the
beginning of an entry, which ends with the prefix, does. So all prefixes share the states of
their places and the scores ahead; a prefix has states of its own at its end only, and one fold back from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, inf
from typing import NamedTuple

from mojiweave.plans import reading as R

# --- fixed values: how far evidence supports a reading ---
SUPPORT = {
    "english-lexeme": 0.98, "japanese-lexeme": 0.98, "japanese-phrase": 0.98,
    "japanese-particle": 0.96, "japanese-auxiliary": 0.96, "japanese-verb": 0.96, "japanese-verb-suffix": 0.96,
    "japanese-romaji-alias": 0.93, "romaji-fallback": 0.50, "lexicon-prefix": 0.38, "unknown-character": 0.05,
}


class Segment(NamedTuple):
    start: int
    end: int
    raw: str
    converted: str
    language: str
    complete: bool
    evidence: str
    score: float


LONGEST_ENTRY = R.SIZES[0]


def whole(text: str, at: int, longest: int = 16) -> list[Segment]:
    """Entries and kana spans of two letters or more from a place on; of equal ones the first."""
    out = [Segment(at, at + len(e.raw), e.raw, e.output, e.language, True, e.evidence, e.weight) for e in R.entries_at(text, at)]
    for end in range(at + 2, min(len(text), at + longest) + 1):
        if kana := R.to_kana(text[at:end]):
            out.append(Segment(at, end, text[at:end], kana, "Japanese", True, "romaji-fallback", 0.15 + (end - at) * 0.055))
    seen: dict[tuple, Segment] = {}
    for c in out:
        seen.setdefault((c.end, c.language, c.converted), c)
    return list(seen.values())


def begun(text: str, at: int) -> list[Segment]:
    """The beginning of an entry from a place up to the end of the text, if it is one."""
    tail = text[at:]
    found = [e for e in R.BY_RAW.values() if len(e.raw) > len(tail) and e.raw.startswith(tail)] if len(tail) < LONGEST_ENTRY else []
    if not found:
        return []
    kinds = {e.language for e in found}
    language = kinds.pop() if len(kinds) == 1 else "Unknown"
    shown = (R.to_kana(tail) if language == "Japanese" else None) or tail
    return [Segment(at, len(text), tail, shown, language, False, "lexicon-prefix", 0.75 + 0.11 * len(tail) + 0.05 * max(e.weight for e in found))]


def unknown(text: str, at: int) -> Segment:
    return Segment(at, at + 1, text[at], text[at], "Unknown", False, "unknown-character", -3.2)


def transition(before: Segment | None, now: Segment) -> float:
    if before is None:
        return 0.0
    score = 0.18 * (before.language == now.language != "Unknown") + 0.65 * (now.evidence == "japanese-particle")
    if now.evidence in ("japanese-verb-suffix", "japanese-romaji-alias"):
        score += 1.05 if before.language == "English" else 0.40
    return score + 0.45 * (now.language == "English" and before.evidence == "japanese-particle") - 0.35 * (not now.complete)


def _add(into: list, state: tuple, c: Segment, width: int) -> None:
    into.append((state[0] + c.score + transition(state[1], c) - 0.55, c, state))
    if len(into) > 2 * width:
        into.sort(key=lambda s: -s[0])
        del into[width:]


def _by_end(text: str) -> list[list[tuple[int, list[Segment]]]]:
    """For each place the segments that end there but for beginnings of entries, by their starts."""
    out: list[list[tuple[int, list[Segment]]]] = [[] for _ in range(len(text) + 1)]
    for i in range(len(text)):
        ends: dict[int, list[Segment]] = {}
        for c in whole(text, i):
            ends.setdefault(c.end, []).append(c)
        for end, found in ends.items():
            out[end].append((i, found))
    return out


def beams(text: str, width: int = 64) -> Iterator[list[tuple[float, list[Segment]]]]:
    """The best hypotheses of each prefix. A place keeps up to twice the width; beyond that it is cut to the width."""
    at: list[list] = [[(0.0, None, None)]]
    ending = _by_end(text)
    for m in range(1, len(text) + 1):
        known, prefix = dict(ending[m]), text[:m]
        going, last = [], []
        for i in sorted({*known, *range(max(0, m - LONGEST_ENTRY), m)}):
            own, more = known.get(i, []), begun(prefix, i)
            rest = [unknown(text, i)] if i == m - 1 else []
            for state in at[i]:
                for c in own:
                    _add(going, state, c, width)
                    _add(last, state, c, width)
                for c in more:
                    _add(last, state, c, width)
                for c in rest:
                    _add(going, state, c, width)
                    _add(last, state, c, width)
        at.append(going)
        out = []
        for state in sorted(last, key=lambda s: -s[0])[:width]:
            score, path = state[0], []
            while state[1] is not None:
                path.append(state[1])
                state = state[2]
            out.append((score, path[::-1]))
        yield out


def _worth(c: Segment) -> float:
    if c.evidence == "unknown-character":
        return -4.0
    return c.score + 0.8 * SUPPORT.get(c.evidence, 0.20) - 0.95 if c.complete else -1.8 + 0.4 * SUPPORT.get(c.evidence, 0.20)


def throughs(text: str) -> Iterator[list[float]]:
    """For each prefix and each place in it from 1: how near the best reading with a boundary there comes to the best of all."""
    edges = [[(i, max(map(_worth, found))) for i, found in known] + ([(k - 1, -4.0)] if k else []) for k, known in enumerate(_by_end(text))]
    ahead = [0.0]
    for m in range(1, len(text) + 1):
        own = [(i, max(map(_worth, found))) for i in range(max(0, m - LONGEST_ENTRY), m) if (found := begun(text[:m], i))]
        ahead.append(max(ahead[i] + w for i, w in edges[m]))
        best = max([ahead[m], *(ahead[i] + w for i, w in own)])
        back = [-inf] * m + [0.0]
        for i, w in own:
            back[i] = w
        for k in range(m, 0, -1):
            for i, w in edges[k]:
                back[i] = max(back[i], back[k] + w)
        yield [min(1.0, exp(min(0.0, (ahead[i] if i < m else best) + back[i] - best) / 1.35)) for i in range(1, m + 1)]
