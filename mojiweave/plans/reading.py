"""The sequential part of reading romaji, in plain Python: shared by the batch and the streaming form."""

from __future__ import annotations

from functools import lru_cache
from math import log

from mojiweave.sources.fixed import BINDING, ENGLISH_SEEDS, ENTRIES, HARD, JAPANESE_SEEDS, KANA, NEUTRAL, PREFIXES

LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
WORD = LETTERS | frozenset("0123456789")
BINDERS, BREAKS, NEUTRALS = frozenset(BINDING), frozenset(HARD + " "), frozenset(NEUTRAL)
SYMBOLS = BINDERS | BREAKS | NEUTRALS
ALLOWED = WORD | SYMBOLS
#: Entries by their text; each text has one entry.
BY_RAW = {e.raw: e for e in ENTRIES}
SIZES = sorted({len(e.raw) for e in ENTRIES}, reverse=True)
_OPEN = frozenset(PREFIXES)


@lru_cache(maxsize=200_000)
def _entries(rest: str) -> tuple:
    return tuple(e for n in SIZES if n <= len(rest) and (e := BY_RAW.get(rest[:n])) is not None)


def entries_at(text: str, at: int) -> tuple:
    """The dictionary entries that stand at a place, longest first."""
    return _entries(text[at : at + SIZES[0]])


def syllable(text: str, at: int) -> tuple[int, str] | None:
    """The kana token of letters at a place: its length and kana."""
    return _syllable(text[at : at + 3])


@lru_cache(maxsize=200_000)
def _syllable(text: str) -> tuple[int, str] | None:
    c, following = text[0], text[1:2]
    if c == following and c in LETTERS and c not in "aiueon":
        return 1, "っ"
    if c == "n":
        if following == "n":
            return 2, "ん"
        if not following or following not in "aiueoy":
            return 1, "ん"
    for n in (3, 2, 1):
        if n <= len(text) and (k := KANA.get(text[:n])) is not None:
            return n, k
    return None


@lru_cache(maxsize=200_000)
def to_kana(span: str) -> str | None:
    """A span of letters in kana, None unless all of it converts."""
    out, at = [], 0
    while at < len(span):
        if (got := syllable(span, at)) is None:
            return None
        out.append(got[1])
        at += got[0]
    return "".join(out) if out else None


def units(text: str) -> list[tuple[int, int, str, str, float]]:
    """(start, end, preview, kind, confidence) of a text's phonetic units."""
    out, at, n = [], 0, len(text)
    while at < n:
        c = text[at]
        if c not in LETTERS:
            out.append((at, at + 1, c, "Symbol", 1.0 if c in SYMBOLS else 0.65))
            at += 1
        elif got := syllable(text, at):
            out.append((at, at + got[0], got[1], "Kana", 1.0))
            at += got[0]
        elif n - at <= 3 and text[at:] in _OPEN:
            out.append((at, n, f"{{{text[at:]}…}}", "Ambiguous", 0.35))
            at = n
        else:
            out.append((at, at + 1, f"{{{c}?}}", "Pending", 0.05))
            at += 1
    return out


def preview(text: str) -> str:
    return "".join(u[2] for u in units(text))


def readability(found: list, start: int, end: int) -> float:
    """Mean confidence of the units over [start, end), weighted by overlap, symbols left out."""
    total = weight = 0.0
    for a, b, _, kind, c in found:
        size = min(b, end) - max(a, start)
        if size > 0 and kind != "Symbol":
            total += c * size
            weight += size
    return total / weight if weight else 0.0


def unresolved(text: str) -> float:
    """What of the letters is neither kana nor, at 0.35, a beginning of kana."""
    letters = sum(c in LETTERS for c in text)
    if not letters:
        return 0.0
    kana = sum(b - a for a, b, _, k, _ in units(text) if k == "Kana")
    some = sum(b - a for a, b, _, k, _ in units(text) if k == "Ambiguous")
    return min(1.0, max(0.0, 1.0 - kana / letters - some / letters * 0.35))


def _grams(word: str) -> list[str]:
    s = f"^{word}$"
    return [s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)]


def _profile(words: list[str]) -> tuple[dict[str, int], float]:
    counts: dict[str, int] = {}
    for w in words:
        for g in _grams(w):
            counts[g] = counts.get(g, 0) + 1
    return counts, max(1, sum(counts.values())) + 0.35 * max(32, len(counts))


_PROFILES = tuple(_profile([e.raw for e in ENTRIES if e.language == k] + seeds) for k, seeds in (("Japanese", JAPANESE_SEEDS), ("English", ENGLISH_SEEDS)))


@lru_cache(maxsize=200_000)
def profile_scores(raw: str) -> tuple[float, float]:
    """Mean log-likelihood of the letters' grams in the Japanese and the English profile."""
    letters = "".join(c for c in raw if c in LETTERS)
    if not letters:
        return -8.0, -8.0
    grams = _grams(letters)
    ja, en = (sum(log((counts.get(g, 0) + 0.35) / below) for g in grams) / len(grams) for counts, below in _PROFILES)
    return ja, en


def lean(raw: str, english: bool) -> float:
    """How much more the text looks like English (or Japanese) than the other, at most 2.5."""
    ja, en = profile_scores(raw)
    return max(-2.5, min(2.5, en - ja if english else ja - en))
