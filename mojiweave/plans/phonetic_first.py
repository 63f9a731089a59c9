"""The phonetic-first session: read all as kana, anchor Latin words in it, fill the gaps, freeze what holds.

What is frozen softly can thaw when something odd turns up nearby; what is frozen hard cannot. The
functions are pure; the session's state is its committed segments, its input and a counter.

A text is read in pieces, each up to and with a symbol that breaks words: no entry, token, kana or
gap goes across one, so a piece's reading depends on its own characters alone, on whether the active part begins with it
and, for what is odd in it, on whether enough characters follow. A keystroke therefore reads the
last piece anew, and of the others only those near the place up to which the input is frozen.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

from mojiweave.operators.orthography import evidence as symbols_of
from mojiweave.plans import reading as R

ACTIVE, SOFT, HARD = "Active", "SoftFrozen", "HardFrozen"


@dataclass(frozen=True)
class PhoneticParameters:
    lookahead: int = 2
    longest_fallback: int = 16
    english_anomaly: float = 0.80
    freeze: float = 0.86
    low_confidence: float = 0.86
    hard_lookahead: int = 12
    segment_radius: int = 2
    radius: int = 6
    decay: float = 0.45
    trigger: float = 0.45


class Segment(NamedTuple):
    start: int
    end: int
    raw: str
    output: str
    language: str
    confidence: float
    reason: str
    state: str = ACTIVE
    penalty: float = 0.0


class Ripple(NamedTuple):
    """Something odd at [start, end); affected is the range it was applied to."""

    start: int
    end: int
    kind: str
    strength: float
    affected: tuple[int, int]
    reason: str


def _is(e, *, japanese: bool = True, weight: float = 0.0, size: int = 1) -> bool:
    return (e.language == "Japanese") == japanese and e.weight >= weight and len(e.raw) >= size


def _ends_strong(text: str, at: int) -> bool:
    return any(_is(e, weight=5.2) and s + len(e.raw) == at for s in range(max(0, at - R.SIZES[0]), at) for e in R.entries_at(text, s))


def _starts_strong(text: str, at: int) -> bool:
    kinds = ("japanese-particle", "japanese-verb-suffix", "japanese-auxiliary", "japanese-verb")
    return at < len(text) and any(_is(e, weight=5.1) and (e.evidence in kinds or len(e.raw) >= 3) for e in R.entries_at(text, at))


class Anchor(NamedTuple):
    start: int
    end: int
    raw: str
    score: float
    readability: float
    kind: str  # orthographic, contextual or anomaly


def anchors(text: str, marks: list[tuple], p: PhoneticParameters, first: bool = True) -> list[Anchor]:
    """Latin words and tokens that do not overlap: tokens first, then by score and length. first: whether text begins what is read."""
    found = [Anchor(a, b, raw, 9.0 + 0.05 * len(raw), 0.0, "orthographic") for a, b, raw, kind, _, complete, _ in marks if kind == "LatinBindingToken" and complete]
    for at in range(len(text)):
        for e in R.entries_at(text, at):
            if e.language != "English":
                continue
            end = at + len(e.raw)
            reads = R.readability(R.units(e.raw), 0, len(e.raw))
            rescued = False
            if len(e.raw) >= 5:
                left, right = _ends_strong(text, at), _starts_strong(text, end)
                rescued = left and (right or end == len(text)) or first and at == 0 and right
            odd = reads <= p.english_anomaly
            if odd or rescued:
                lexical = max(0.0, min(1.0, (e.weight - 3.5) / 3.5))
                score = 2.0 * lexical + 2.5 * (1.0 - reads) + 0.03 * len(e.raw) + 2.0 * rescued
                found.append(Anchor(at, end, e.raw, score, reads, "anomaly" if odd else "contextual"))
    chosen: list[Anchor] = []
    for a in sorted(found, key=lambda a: (a.kind != "orthographic", -a.score, a.start - a.end)):
        if all(a.end <= c.start or c.end <= a.start for c in chosen):
            chosen.append(a)
    return sorted(chosen)


def _anchored(a: Anchor) -> Segment:
    if a.kind == "orthographic":
        sure, why = 0.98, "stage2-orthographic-latin-token"
    elif a.kind == "contextual":
        sure, why = 0.94, "stage2-english-from-context-boundaries"
    else:
        sure, why = max(0.0, min(0.99, 0.90 + (1.0 - a.readability) * 0.08)), "stage2-english-from-phonetic-anomaly"
    return Segment(a.start, a.end, a.raw, a.raw, "English", sure, why)


def _short_whole(text: str, at: int, end: int) -> str | None:
    """Kana of a short rest as one piece: it has a particle inside, and no strong word begins in it."""
    if not 3 <= end - at <= 8:
        return None
    inside = [(s, e) for s in range(at + 1, end) for e in R.entries_at(text, s) if e.language == "Japanese"]
    if not any(e.evidence == "japanese-particle" and s + len(e.raw) < end for s, e in inside):
        return None
    if any(e.evidence != "japanese-particle" and len(e.raw) >= 3 and e.weight >= 5.2 and s + len(e.raw) <= end for s, e in inside):
        return None
    span = text[at:end]
    return R.to_kana(span) if all(c in R.LETTERS for c in span) else None


def fill(text: str, at: int, end: int, p: PhoneticParameters) -> list[Segment]:
    """The gap [at, end) left to right: symbols, dictionary words, short wholes, kana up to the next known place, single letters."""
    out: list[Segment] = []
    while at < end:
        c = text[at]
        if c not in R.LETTERS:
            hard = c in R.BREAKS
            out.append(Segment(at, at + 1, c, c, "Unknown", 0.99 if hard else 0.70, "stage2-hard-boundary-symbol" if hard else "stage2-symbol"))
        elif known := next((e for e in R.entries_at(text, at) if e.language == "Japanese" and at + len(e.raw) <= end), None):
            out.append(Segment(at, at + len(known.raw), known.raw, known.output, "Japanese", 0.92 if known.evidence == "japanese-romaji-alias" else 0.96, f"stage2-{known.evidence}"))
        elif kana := _short_whole(text, at, end):
            out.append(Segment(at, end, text[at:end], kana, "Japanese", 0.84, "stage2-short-whole-phonetic"))
        else:
            stop = next((s for s in range(at + 1, end) if text[s] not in R.LETTERS or any(_is(e, weight=5.2, size=3) and s + len(e.raw) <= end for e in R.entries_at(text, s))), end)
            for to in range(min(stop, at + p.longest_fallback), at, -1):
                if kana := R.to_kana(text[at:to]):
                    held = to < end and any(e.language == "Japanese" for e in R.entries_at(text, to))
                    out.append(Segment(at, to, text[at:to], kana, "Japanese", 0.89 if held else 0.80, "stage2-phonetic-fallback" + "-boundary-supported" * held))
                    break
            else:
                out.append(Segment(at, at + 1, c, c, "Unknown", 0.15, "stage2-unresolved"))
        at = out[-1].end
    return out


def _resolve_piece(text: str, p: PhoneticParameters, first: bool) -> tuple[list[Segment], list[tuple]]:
    marks, out, at = symbols_of(text), [], 0
    for a in anchors(text, marks, p, first):
        out += fill(text, at, a.start, p)
        out.append(_anchored(a))
        at = a.end
    return out + fill(text, at, len(text), p), marks


def pieces_of(text: str) -> Iterator[tuple[int, str]]:
    """(start, piece) of a text cut after each symbol that breaks words."""
    at = 0
    for i, c in enumerate(text):
        if c in R.BREAKS:
            yield at, text[at : i + 1]
            at = i + 1
    if at < len(text):
        yield at, text[at:]


def resolve(text: str, p: PhoneticParameters) -> tuple[list[Segment], list[tuple]]:
    """The segments of a text and its symbol evidence."""
    segments, marks = [], []
    for at, piece in pieces_of(text):
        r = read_piece(piece, at == 0, 0, p)
        segments += [s._replace(start=at + s.start, end=at + s.end) for s in r.segments]
        marks += [(at + a, at + b, *rest) for a, b, *rest in r.marks]
    return segments, marks


class Reading(NamedTuple):
    """What a piece reads as, in its own places."""

    segments: tuple[Segment, ...]
    marks: tuple[tuple, ...]
    odd: tuple[Ripple, ...]
    output: str


@lru_cache(maxsize=100_000)
def read_piece(text: str, first: bool, rest: int, p: PhoneticParameters) -> Reading:
    """A piece that begins what is read (or not) and is followed by at least `rest` more characters."""
    segments, marks = _resolve_piece(text, p, first)
    return Reading(tuple(segments), tuple(marks), tuple(oddities(text, segments, marks, rest, p)), "".join(s.output for s in segments))


#: Kinds of oddities, in the order in which they are listed.
ODD = ("PendingPhonetic", "InteriorAmbiguity", "UnknownSegment", "LowConfidenceSegment", "IncompleteBindingToken")


def oddities(text: str, segments: list[Segment], marks: list[tuple], rest: int, p: PhoneticParameters) -> list[Ripple]:
    """What may shake its neighbourhood; the strongest of each place and kind. rest: characters that follow."""
    n, found = len(text) + rest, []

    def add(start: int, end: int, kind: str, strength: float, why: str) -> None:
        found.append(Ripple(start, end, kind, strength, (0, 0), why))

    latin = [s for s in segments if s.language == "English" and s.confidence >= 0.90]
    for a, b, _, kind, _ in R.units(text):
        if any(s.start <= a and b <= s.end for s in latin):
            continue
        if kind == "Pending":
            add(a, b, "PendingPhonetic", 0.35 if b == n else 1.0, "not-readable-as-romaji-here")
        elif kind == "Ambiguous" and b < n:
            add(a, b, "InteriorAmbiguity", 0.55, "incomplete-romaji-prefix")
    plain = [s for s in segments if "symbol" not in s.reason]
    for s in plain:
        if s.language == "Unknown":
            add(s.start, s.end, "UnknownSegment", 1.0, s.reason)
    for s in plain:
        if s.language != "Unknown" and s.confidence < p.low_confidence and n - s.end >= p.lookahead:
            gap = max(0.0, min(1.0, (p.low_confidence - s.confidence) / max(p.low_confidence, 0.0001)))
            add(s.start, s.end, "LowConfidenceSegment", max(p.trigger, min(1.0, p.trigger + gap * (1.0 - p.trigger))), f"{s.reason};confidence={s.confidence:.3f}")
    for a, b, _, kind, _, _, why in marks:
        if kind == "IncompleteBindingToken":
            add(a, b, kind, 0.95, why)
    best: dict[tuple, Ripple] = {}
    for r in found:
        if (k := r[:3]) not in best or r.strength > best[k].strength:
            best[k] = r
    return list(best.values())


def apart(a0: int, a1: int, b0: int, b1: int) -> int:
    return max(0, b0 - a1, a0 - b1)


class Step(NamedTuple):
    """What one keystroke left behind."""

    step: int
    input: str
    committed_raw_length: int
    hard_raw_length: int
    committed_output: str
    active_raw: str
    preview: str
    segments: list[Segment]
    frozen: list[Segment]
    output: str
    analyzed: int
    total_analyzed: int
    rebuilt: bool
    marks: list[tuple]
    ripples: list[Ripple]
    thaws: list[tuple[int, int, list[str], str]]
    transitions: list[tuple[int, int, str, str, str, str]]


class Change(NamedTuple):
    """What one keystroke changed: of the output before, `kept` characters stay, and `shown` follows them."""

    step: int
    hard_raw_length: int
    kept: int
    shown: str
    analyzed: int
    total_analyzed: int


@dataclass
class PhoneticSession:
    """steps() makes whole frames; keys() only what a keystroke changed, and does not look at what it cannot have changed."""

    p: PhoneticParameters = field(default_factory=PhoneticParameters)
    input: str = ""
    committed: list[Segment] = field(default_factory=list)
    total: int = 0

    def __post_init__(self):
        self.cuts = [i + 1 for i, c in enumerate(self.input) if c in R.BREAKS]
        self.n_hard = sum(s.state == HARD for s in self.committed)  # hard segments come before soft ones
        self._sums = list(accumulate(len(s.output) for s in self.committed))
        self.stuck = -1  # a place from which nothing can be frozen any more, whatever follows
        self._place()

    def update(self, text: str) -> list[Step]:
        """The steps of the characters that text adds; of all of them, marked rebuilt, if it does not continue the input."""
        return list(self.steps(text))

    def restart(self) -> None:
        self.input, self.committed, self.total = "", [], 0
        self.__post_init__()

    def steps(self, text: str) -> Iterator[Step]:
        """The same, one by one."""
        text = plain(text)
        again = not text.startswith(self.input)
        if again:
            self.restart()
        for c in text[len(self.input) :]:
            yield self._step(c, again)

    @property
    def done(self) -> int:
        return self.committed[-1].end if self.committed else 0

    @property
    def hard(self) -> int:
        return self.committed[self.n_hard - 1].end if self.n_hard else 0

    def _pieces(self, base: int) -> Iterator[tuple[int, Reading]]:
        """(place after base, reading) of the pieces of the input from base on."""
        n, at, k = len(self.input), base, bisect_right(self.cuts, base)
        while at < n:
            end = self.cuts[k] if k < len(self.cuts) else n
            yield at - base, read_piece(self.input[at:end], at == base, min(n - end, self.p.lookahead), self.p)
            at, k = end, k + 1

    def _odd(self, base: int, within: int | None = None) -> list[Ripple]:
        """Oddities from base on in global places, of pieces that begin within so many characters; by kind, then place."""
        found, n = [], len(self.input)
        for at, r in self._pieces(base):
            if within is not None and at > within:
                break
            found += [o._replace(start=base + at + o.start, end=base + at + o.end, affected=(base, n)) for o in r.odd]
        return sorted(found, key=lambda r: max(1, ODD.index(r.kind)))

    def _soft_tail(self) -> int | None:
        """Index of the first of the last soft segments; None if there is none."""
        return max(self.n_hard, len(self.committed) - self.p.segment_radius) if len(self.committed) > self.n_hard else None

    def _thaw(self, kinds: list[str]) -> bool:
        first = self._soft_tail()
        if first is None:
            return False
        gone = self.committed[first:]
        del self.committed[first:]
        reason = "+".join(dict.fromkeys(kinds))
        self._thaws.append((gone[0].start, gone[-1].end, [s.raw for s in gone], reason))
        self._moves += [(s.start, s.end, s.raw, SOFT, ACTIVE, f"context-ripple:{reason}") for s in gone]
        return True

    def _probe(self) -> None:
        """Reads the soft tail and what follows anew: a good segment across the boundary thaws the tail."""
        first, boundary = self._soft_tail(), self.done
        if first is None or len(self.input) <= boundary:
            return
        start, end = self.committed[first].start, min(len(self.input), boundary + max(2 * self.p.radius, 8))
        found, _ = resolve(self.input[start:end], self.p)
        crossing = [s for s in found if s.start < boundary - start < s.end]
        if crossing:
            best = max(crossing, key=lambda s: s.confidence)
            if best.language != "Unknown" and best.confidence >= self.p.freeze:
                self._ripples.append(Ripple(boundary, boundary, "CrossBoundaryReinterpretation", 1.0, (start, end), f"{best.reason}:{best.raw}"))
                self._thaw(["CrossBoundaryReinterpretation"])

    def _harden(self, least: int, why: str) -> None:
        """The soft segments that at least so many characters follow turn hard."""
        while self.n_hard < len(self.committed) and len(self.input) - (s := self.committed[self.n_hard]).end >= least:
            self.committed[self.n_hard] = s._replace(state=HARD)
            self._moves.append((s.start, s.end, s.raw, SOFT, HARD, why))
            self.n_hard += 1

    def _penalty(self, a: int, b: int, odd: list[Ripple]) -> float:
        return max((min(0.70, r.strength * self.p.decay**d) for r in odd if (d := apart(a, b, r.start, r.end)) <= self.p.radius), default=0.0)

    def _shaken(self, s: Segment, odd: list[Ripple]) -> Segment:
        penalty = self._penalty(s.start, s.end, odd)
        if penalty > 0 and s.reason != "stage2-orthographic-latin-token":
            s = s._replace(confidence=s.confidence * (1.0 - penalty), penalty=penalty)
        return s

    def _segments(self, base: int) -> Iterator[Segment]:
        for at, r in self._pieces(base):
            yield from (s._replace(start=base + at + s.start, end=base + at + s.end) for s in r.segments)

    def _firm(self, base: int) -> list[Segment]:
        """The leading segments that can be frozen; reads no further than it has to."""
        out, n, rest = [], len(self.input), self._segments(base)
        s = next(rest, None)
        while s is not None and n - s.end >= self.p.lookahead:
            following = next(rest, None)
            odd = self._odd(base, s.end - base + self.p.radius)
            own = self._shaken(s, odd)
            if s.reason == "stage2-phonetic-fallback" and following is not None and following.reason.startswith("stage2-japanese-"):
                own = own._replace(confidence=max(own.confidence, 0.88))
            if own.confidence < self.p.freeze or s.language == "Unknown" or any(r.strength >= self.p.trigger and apart(s.start, s.end, r.start, r.end) <= self.p.radius for r in odd):
                # what was read lies in pieces up to the next cut; once enough follows that, it reads alike for ever
                k = bisect_right(self.cuts, max(s.end + self.p.radius, following.end if following else n))
                if not out and k < len(self.cuts) and n - self.cuts[k] >= self.p.lookahead:
                    self.stuck = base
                break
            out.append(own._replace(state=SOFT))
            s = following
        return out

    def _key(self, c: str, watch) -> tuple[list[Segment], int]:
        """Takes one character: what it froze, and the characters read. watch(base) is told each place from which segments are shaken."""
        self.input += c
        if c in R.BREAKS:
            self.cuts.append(len(self.input))
        n = len(self.input)
        self._thaws, self._moves, self._ripples = [], [], []
        self._probe()
        self._harden(self.p.hard_lookahead, "sufficient-lookahead-without-local-contradiction")
        base = self.done
        work = n - base
        if self._soft_tail() is not None and any(r.strength >= self.p.trigger and r.start - base <= self.p.radius for r in self._odd(base, self.p.radius)):
            self._thaw([r.kind for r in self._odd(base)])
            base = self.done
            work += n - base
        watch(base)
        frozen = [] if self.stuck == base else self._firm(base)
        if frozen:
            self.committed += frozen
            self._moves += [(s.start, s.end, s.raw, ACTIVE, SOFT, "high-confidence-with-lookahead") for s in frozen]
            base = self.done
            work += n - base
            watch(base)
        if self.cuts and self.cuts[-1] > base:
            self._harden(0, "hard-boundary-observed")
        self.total += work
        return frozen, work

    def bare_step(self, c: str) -> Step:
        """A step without what is odd in it: no preview, marks and ripples, and active segments as they were before they are shaken."""
        frozen, work = self._key(c, lambda base: None)
        active, said = list(self._segments(self.done)), "".join(s.output for s in self.committed)
        return Step(len(self.input), self.input, self.done, self.hard, said, self.input[self.done :], "", active, frozen, said + "".join(s.output for s in active), work, self.total, False, [], [], self._thaws, self._moves)

    def _step(self, c: str, rebuilt: bool) -> Step:
        active: list[Segment] = []

        def watch(base: int) -> None:
            odd = self._odd(base)
            active[:] = [self._shaken(s, odd) for s in self._segments(base)]
            self._ripples += [r._replace(affected=(s.start, s.end), reason=f"{r.reason};distance={d}") for s in active for r in odd if (d := apart(s.start, s.end, r.start, r.end)) <= self.p.radius]

        frozen, work = self._key(c, watch)
        base = self.done
        text, said = self.input[base:], "".join(s.output for s in self.committed)
        marks = [(at + a, at + b, *rest) for at, r in self._pieces(base) for a, b, *rest in r.marks]
        return Step(len(self.input), self.input, base, self.hard, said, text, R.preview(text), active, frozen, said + "".join(s.output for s in active), work, self.total, rebuilt, marks, self._ripples, self._thaws, self._moves)

    # --- only what changes ---

    def saved(self) -> list:
        """What keys() needs to go on: the hard segments are one number of characters."""
        return [self.input, self.hard, self._sums[self.n_hard - 1] if self.n_hard else 0, [list(s) for s in self.committed[self.n_hard :]], self.total]

    @classmethod
    def loaded(cls, p: PhoneticParameters, saved: list) -> PhoneticSession:
        text, hard, chars, soft, total = saved
        known = [Segment(0, hard, "", "\0" * chars, "", 1.0, "", HARD)] if hard else []
        return cls(p, text, known + [Segment(*x) for x in soft], total)

    @property
    def settled(self) -> tuple | None:
        """All that later changes depend on once nothing can be frozen or thawed: the last piece, whether it begins what is read, and what is shown of it; None before."""
        if len(self.committed) > self.n_hard or self.stuck != self.done:
            return None
        return self.input[self._at :], self._at == self._base, self._last

    @property
    def shown_before(self) -> int:
        """Characters shown before the last piece."""
        return self._before

    def _place(self) -> str:
        """Notes where the last piece begins and how much is shown before it; what is shown of the active part."""
        self._base, self._at, self._before, self._last = self.done, self.done, self._sums[-1] if self._sums else 0, ""
        out = []
        for at, r in self._pieces(self._base):
            out.append(r.output)
            self._at, self._last = self._base + at, r.output
        self._before += sum(map(len, out)) - len(self._last)
        if self.cuts and self.cuts[-1] == len(self.input) > self._at:
            self._at, self._before, self._last = len(self.input), self._before + len(self._last), ""
        return "".join(out)

    def keys(self, text: str) -> Iterator[Change]:
        """The changes that the characters of text make, one for each."""
        for c in text:
            low = len(self.committed) if (tail := self._soft_tail()) is None else tail
            _, work = self._key(c, lambda base: None)
            if self.done == self._base and not self._thaws:
                new, n = read_piece(self.input[self._at :], self._at == self._base, 0, self.p).output, 0
                while n < min(len(new), len(self._last)) and new[n] == self._last[n]:
                    n += 1
                kept, shown, self._last = self._before + n, new[n:], new
                if c in R.BREAKS:
                    self._at, self._before, self._last = len(self.input), self._before + len(new), ""
            else:
                del self._sums[low:]
                kept = self._sums[-1] if self._sums else 0
                for s in self.committed[low:]:
                    self._sums.append((self._sums[-1] if self._sums else 0) + len(s.output))
                shown = "".join(s.output for s in self.committed[low:]) + self._place()
            yield Change(len(self.input), self.hard, kept, shown, work, self.total)


def plain(text: str) -> str:
    """The text as a session takes it: in lower case, all characters allowed."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    if bad := [c for c in text if c not in R.ALLOWED]:
        raise ValueError(f"not allowed: {bad[0]!r}")
    return text


class Typing:
    """Sessions of texts one after the other: the keystrokes that a text has in common with the one before it are not typed again.

    bare: whether to keep a bare step of every keystroke.
    """

    def __init__(self, p: PhoneticParameters, bare: bool = False):
        self.session, self.bare = PhoneticSession(p), bare
        self._trail: list[tuple] = [((), 0, None)]  # after so many keystrokes: committed, total and the step

    def type(self, text: str) -> PhoneticSession:
        """The session after the text's last keystroke."""
        s, text, same = self.session, plain(text), 0
        while same < min(len(text), len(s.input)) and text[same] == s.input[same]:
            same += 1
        del self._trail[same + 1 :]
        committed, s.total, _ = self._trail[same]
        s.input, s.committed = text[:same], list(committed)
        s.cuts = [i + 1 for i, c in enumerate(s.input) if c in R.BREAKS]
        s.n_hard, s.stuck = sum(x.state == HARD for x in s.committed), -1
        for c in text[same:]:
            step = s.bare_step(c) if self.bare else s._key(c, lambda base: None) and None
            self._trail.append((tuple(s.committed), s.total, step))
        return s

    def steps(self) -> list[Step]:
        return [step for _, _, step in self._trail[1:]]

    def output(self) -> str:
        s = self.session
        return "".join(x.output for x in s.committed) + "".join(r.output for _, r in s._pieces(s.done))
