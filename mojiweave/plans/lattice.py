"""The evidence lattice: candidate edges of a text and the best paths through them.

Generation, scoring and the incremental session are pure functions on one text or one session state,
so that the batch form (a text per row) and the streaming form (a state per session) share them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import itemgetter
from typing import NamedTuple

from mojiweave.plans import reading as R
from mojiweave.sources.fixed import LatticeParameters


class Edge(NamedTuple):
    """A candidate over [start, end)."""

    start: int
    end: int
    raw: str
    output: str
    language: str
    kind: str
    score: float
    japanese: float
    english: float
    evidence: str

    @property
    def key(self) -> tuple:
        return self.start, self.end, self.output, self.language, self.kind


class Path(NamedTuple):
    score: float
    edges: tuple[Edge, ...]


def _plain(at: int, c: str) -> Edge:
    """A symbol's edge, or that of a character nothing is known about."""
    if c in R.BREAKS:
        kind, score, why = "HardBoundary", 1.0, "hard-boundary"
    elif c in R.BINDERS:
        kind, score, why = "BindingSymbol", 0.10, "standalone-binding-symbol"
    elif c in R.NEUTRALS:
        kind, score, why = "NeutralSymbol", 0.45, "neutral-symbol"
    else:
        kind, score, why = "Unknown", -3.2, "unknown-character"
    return Edge(at, at + 1, c, c, "Unknown", kind, score, -8.0, -8.0, why)


def lexical_edge(at: int, e) -> Edge:
    n = len(e.raw)
    if e.language == "Japanese":
        score = n - 0.45 + (0.45 if e.evidence == "japanese-particle" else 0.95) + 0.10 * e.weight + 0.35 * R.lean(e.raw, False)
        kind = "JapaneseLexical"
    else:
        short = 2.35 if n < 5 and R.to_kana(e.raw) else 0.0
        score = n - 0.45 + (1.80 if n >= 5 else 0.20) + 0.10 * e.weight + 0.50 * R.lean(e.raw, True) - short
        kind = "EnglishLexical"
    return Edge(at, at + n, e.raw, e.output, e.language, kind, round(score, 9), *R.profile_scores(e.raw), e.evidence)


def phonetic_edge(at: int, span: str, kana: str) -> Edge:
    return Edge(at, at + len(span), span, kana, "Japanese", "JapanesePhonetic", round(len(span) - 0.55 + 0.42 * R.lean(span, False), 9), *R.profile_scores(span), "phonetic-lattice")


def structural_edge(text: str, start: int, end: int) -> Edge | None:
    """A Latin token around a binding symbol; None if it has no letter."""
    span = text[start:end]
    if not any(c in R.LETTERS for c in span):
        return None
    binders = [i for i, c in enumerate(span) if c in R.BINDERS]
    left, right = span[: binders[0]], span[binders[0] + 1 :]
    score = len(span) - 0.65 + 1.75 + 0.55 * len(binders) + 0.25 * R.lean(span, True) + 0.95 * R.lean(left, True)
    if right:
        score += 0.65 * R.lean(right, True)
    if any(e.language == "Japanese" and e.weight >= 5.1 for e in R.entries_at(text, end)):
        score += 1.80
    if all(c in R.LETTERS for c in left):
        score -= 2.60 if len(left) <= 2 else 0.45 if len(left) == 3 else 0.0
    score -= 0.35 * max(0, len(span) - 12)
    return Edge(start, end, span, span, "English", "LatinStructural", round(score, 9), *R.profile_scores(span), "orthographic-lattice")


def binder_edges(text: str, at: int, p: LatticeParameters) -> list[Edge]:
    """The Latin tokens around the binding symbol at a place."""
    n, c, first = len(text), text[at], at
    while first > max(0, at - p.latin_side) and text[first - 1] in R.WORD:
        first -= 1
    last = at + 1
    while last < min(n, at + 1 + p.latin_side) and text[last] in R.WORD:
        last += 1
    if last > at + 1:
        ends = range(at + 2, last + 1)
    elif c in "#+":
        stop = at + 1
        while c == "+" and text[stop : stop + 1] == "+":
            stop += 1
        ends = range(stop, stop + 1)
    else:
        return []
    return [e for s in range(first, at) for x in ends if (e := structural_edge(text, s, x))]


def structural_edges(text: str, p: LatticeParameters) -> list[Edge]:
    return [e for at, c in enumerate(text) if c in R.BINDERS for e in binder_edges(text, at, p)]


def candidate_edges(text: str, p: LatticeParameters) -> list[Edge]:
    """All edges: structural, then per place symbols, entries and kana spans; of equal ones the best. Ordered by start, length and score."""
    found = structural_edges(text, p)
    held = {e.start for e in found}
    for at, c in enumerate(text):
        if c not in R.WORD:
            found.append(_plain(at, c))
            continue
        own = [lexical_edge(at, e) for e in R.entries_at(text, at)]
        for end in range(at + 1, min(len(text), at + p.phonetic_span) + 1):
            if text[end - 1] not in R.LETTERS:
                break
            if kana := R.to_kana(text[at:end]):
                own.append(phonetic_edge(at, text[at:end], kana))
        if not own and at not in held:
            own.append(Edge(at, at + 1, c, c, "Unknown", "Unknown", -3.2, -8.0, -8.0, "unknown-character"))
        found += own
    best: dict[tuple, Edge] = {}
    for e in found:
        if e.key not in best or e.score > best[e.key].score:
            best[e.key] = e
    return sorted(best.values(), key=lambda e: (e.start, -(e.end - e.start), -e.score))


def transition(before: Edge | None, now: Edge, p: LatticeParameters) -> float:
    particle = now.language == "Japanese" and now.evidence == "japanese-particle"
    if before is None:
        suffix = now.language == "Japanese" and now.evidence in ("japanese-verb-suffix", "japanese-auxiliary")
        return -3.25 * particle - 1.75 * suffix
    if before.kind == "HardBoundary":
        return 0.35
    if now.kind == "HardBoundary":
        return 0.45
    score = 0.0
    if "Unknown" not in (before.language, now.language):
        score += 0.12 if before.language == now.language else -p.switch_penalty
    if particle:
        score += 0.55 * (before.language == "English") - 1.20 * (before.language == "Japanese" and before.evidence == "japanese-particle")
    return score - (now.kind == "Unknown")


_SCORE = itemgetter(0)


class Decoded(NamedTuple):
    edges: list[Edge]
    paths: list[Path]
    expanded: int


def _unknown(at: int, c: str) -> Edge:
    return Edge(at, at + 1, c, c, "Unknown", "Unknown", -3.2, -8.0, -8.0, "unknown-character")


def _walk(state) -> tuple[Edge, ...]:
    out = []
    while state[1] is not None:
        out.append(state[1])
        state = state[2]
    return tuple(reversed(out))


class Window:
    """A text's beam, kept between keystrokes.

    A character added at the end gives edges that end there, and may change Latin tokens shortly
    before it; places before the first edge that changed keep their paths. What a keystroke costs
    so depends on how far back readings reach, not on how long the text is.
    """

    def __init__(self, p: LatticeParameters, text: str = ""):
        self.p, self.text = p, ""
        self._entries: list[list[Edge]] = []
        self._spans: list[list[Edge]] = []
        self._tokens: dict[int, list[Edge]] = {}  # by binding symbol
        self._edges: list[list[Edge]] = []
        self._ready: list[list[Edge]] = []
        self._binder = -1  # the last binding symbol
        self._work: list[int] = []
        # a path is (score, its last edge, the path before it), at the place where it ends, in order of arrival
        self._arriving: list[list] = [[(0.0, None, None)]]
        for c in text:
            self._grow(c)
        self._settle(range(len(text)))
        self._read(0)

    def add(self, c: str) -> None:
        changed = self._grow(c)
        self._settle(changed)
        self._read(min(changed))

    def _settle(self, places) -> None:
        for s in places:
            self._edges[s] = self._at(s)
            self._ready[s] = sorted(self._edges[s], key=lambda e: -e.score)

    def _grow(self, c: str) -> set[int]:
        """The edges of one more character; the places whose edges are not what they were."""
        at = len(self.text)
        self.text += c
        n, text, changed = at + 1, self.text, {at}
        self._entries.append([])
        self._spans.append([])
        self._edges.append([])
        self._ready.append([])
        self._work.append(0)
        self._arriving.append([])
        if c in R.WORD:
            for size in R.SIZES:
                if size <= n and (e := R.BY_RAW.get(text[n - size :])) is not None:
                    self._entries[n - size].insert(0, lexical_edge(n - size, e))  # longest first
                    changed.add(n - size)
        if c in R.LETTERS:
            for s in range(at, max(0, n - self.p.phonetic_span) - 1, -1):
                if text[s] not in R.LETTERS:
                    break
                if kana := R.to_kana(text[s:]):
                    self._spans[s].append(phonetic_edge(s, text[s:], kana))
                    changed.add(s)
        low = max(0, n - R.SIZES[0] - self.p.latin_side - 2)
        while low and text[low - 1] == "+":
            low -= 1
        if c in R.BINDERS:
            self._binder = at
        for k in range(low, self._binder + 1):
            if text[k] in R.BINDERS:
                before, now = self._tokens.get(k, []), binder_edges(text, k, self.p)
                if before != now:
                    self._tokens[k] = now
                    changed |= {e.start for e in set(before) ^ set(now)}
        return changed

    def _at(self, s: int) -> list[Edge]:
        """The edges that start at a place, of equal ones the first of the best; longest first, then best."""
        found = [e for k in range(s + 1, min(self._binder + 1, s + self.p.latin_side + 1)) for e in self._tokens.get(k, ()) if e.start == s]
        c = self.text[s]
        if c not in R.WORD:
            found.append(_plain(s, c))
        elif own := self._entries[s] + self._spans[s]:
            found += own
        elif not found:
            found.append(_unknown(s, c))
        if self._tokens and len(found) > 1:  # a token may be found from each of its symbols
            best: dict[tuple, Edge] = {}
            for e in found:
                if e.key not in best or e.score > best[e.key].score:
                    best[e.key] = e
            found = list(best.values())
        return sorted(found, key=lambda e: (-(e.end - e.start), -e.score))

    def _read(self, first: int) -> None:
        """Paths anew from the place `first` on."""
        for paths in self._arriving[first + 1 :]:
            while paths and paths[-1][1].start >= first:
                paths.pop()
        for at in range(first, len(self.text)):
            kept = sorted(self._arriving[at], key=lambda s: -s[0])[: self.p.beam]
            ready = self._ready[at]
            self._work[at] = len(kept) * len(ready)
            for state in kept:
                score, before, _ = state
                for e in ready:
                    self._arriving[e.end].append((score + e.score + transition(before, e, self.p), e, state))

    @property
    def expanded(self) -> int:
        return sum(self._work)

    def finals(self) -> list:
        """The best paths of the whole text; of equal scores the path that came first."""
        return sorted(self._arriving[-1], key=lambda s: -s[0])[: self.p.beam] if self.text else []

    def decoded(self) -> Decoded:
        return Decoded([e for edges in self._edges for e in edges], [Path(s[0], _walk(s)) for s in self.finals()], self.expanded)


#: Readings of places, and rows of spans, that a worker remembers.
KNOWN = 50_000


class Row(NamedTuple):
    """An edge of a place, whatever the place; steps: what it costs after each class of edge."""

    size: int
    score: float
    steps: tuple[float, ...]
    own: int
    edge: Edge


def _classes() -> dict[tuple, int]:
    """What transition() asks of the edge before, as a number: a break, else the language and whether it is a particle."""
    return {k: i for i, k in enumerate([None, "hard", *((language, particle) for language in ("Japanese", "English", "Unknown") for particle in (False, True))])}


CLASSES = _classes()


def _class(e: Edge) -> int:
    return CLASSES["hard" if e.kind == "HardBoundary" else (e.language, e.evidence == "japanese-particle")]


def _before(k) -> Edge | None:
    """An edge of a class."""
    if k is None:
        return None
    language, particle = ("Unknown", False) if k == "hard" else k
    return Edge(0, 1, "", "", language, "HardBoundary" if k == "hard" else "", 0.0, 0.0, 0.0, "japanese-particle" if particle else "")


_BEFORE = tuple(map(_before, CLASSES))


def _remembered(known: dict, key, make):
    if (got := known.get(key)) is None:
        if len(known) >= KNOWN:
            known.clear()
        got = known[key] = make()
    return got


class Reader:
    """Texts decoded one after the other: what a text has in common with the one before it is not read again.

    The edges of a place depend on the word characters from there on and, over a binding symbol, on those after it: such
    stretches recur, and are read once. Texts that come sorted share their beginnings and so their beams up to the first
    place whose edges differ.
    """

    def __init__(self, p: LatticeParameters):
        self.p = p
        self._known: dict[str, tuple[tuple[Row, ...], tuple[Row, ...]]] = {}
        self._spans: dict[str, Row | tuple] = {}  # of a span read as kana; () if it is not
        self._steps: dict[tuple, tuple[float, ...]] = {}
        self._places: list[tuple] = []  # of each place its rows: longest first, and best first
        self._arriving: list[list] = [[(0.0, None, None)]]
        self._work: list[int] = []

    def _stretches(self, text: str) -> list[str]:
        """Of each place the characters that its edges depend on."""
        n, side, longest = len(text), self.p.latin_side, max(self.p.phonetic_span, R.SIZES[0])
        run = [0] * (n + 1)  # where the word characters from a place on end
        run[n] = n
        for i in range(n - 1, -1, -1):
            run[i] = run[i + 1] if text[i] in R.WORD and i + 1 < n and text[i + 1] in R.WORD else i + (text[i] in R.WORD)
        out = []
        for s in range(n):
            at = run[s]
            if at == s:
                out.append(text[s])
                continue
            end = min(at, s + longest)
            if at - s <= side and at < n and (c := text[at]) in R.BINDERS:
                if at + 1 < n and text[at + 1] in R.WORD:
                    end = min(run[at + 1], at + 1 + side + R.SIZES[0])
                elif c in "#+":
                    stop = at + 1
                    while c == "+" and stop < n and text[stop] == "+":
                        stop += 1
                    end = min(run[stop], stop + R.SIZES[0])
            out.append(text[s:end])
        return out

    def _row(self, e: Edge) -> Row:
        steps = _remembered(self._steps, (e.kind in ("HardBoundary", "Unknown") and e.kind, e.language, e.evidence), lambda: tuple(transition(b, e, self.p) for b in _BEFORE))
        return Row(e.end, e.score, steps, _class(e), e)

    def _span(self, span: str) -> Row | tuple:
        kana = R.to_kana(span)
        return self._row(phonetic_edge(0, span, kana)) if kana else ()

    def _read_place(self, text: str) -> tuple[tuple[Row, ...], tuple[Row, ...]]:
        """The edges that start where text does, longest first, and best first."""
        p, c, row = self.p, text[0], self._row
        if c not in R.WORD:
            found = [row(_plain(0, c))]
        else:
            at = next((i for i, x in enumerate(text) if x not in R.WORD), len(text))
            found = [row(e) for e in binder_edges(text, at, p) if e.start == 0] if at < len(text) and text[at] in R.BINDERS else []
            found += [row(lexical_edge(0, e)) for e in R.entries_at(text, 0)]
            for end in range(1, min(len(text), p.phonetic_span) + 1):
                if text[end - 1] not in R.LETTERS:
                    break
                span = text[:end]
                if got := _remembered(self._spans, span, lambda span=span: self._span(span)):
                    found.append(got)
            found = found or [row(_unknown(0, c))]
        listed = tuple(sorted(found, key=lambda r: (-r.size, -r.score)))
        return listed, tuple(sorted(listed, key=lambda r: -r.score))

    def read(self, text: str) -> None:
        known, arriving, beam, n = self._known, self._arriving, self.p.beam, len(text)
        places = []
        for stretch in self._stretches(text):
            places.append(_remembered(known, stretch, lambda stretch=stretch: self._read_place(stretch)))
        first = next((i for i, (a, b) in enumerate(zip(places, self._places, strict=False)) if a is not b), min(n, len(self._places)))
        self._places = places
        del arriving[n + 1 :], self._work[first:]
        for at in range(first + 1, len(arriving)):
            paths = arriving[at]
            while paths and at - paths[-1][1].size >= first:
                paths.pop()
        arriving += ([] for _ in range(n + 1 - len(arriving)))
        for at in range(first, n):
            kept, ready = sorted(arriving[at], key=_SCORE, reverse=True)[:beam], places[at][1]
            self._work.append(len(kept) * len(ready))
            targets = [(arriving[at + r.size].append, r.score, r.steps, r) for r in ready]
            for state in kept:
                score, before, _ = state
                k = before.own if before else 0
                for put, own, steps, row in targets:
                    put((score + own + steps[k], row, state))

    @property
    def expanded(self) -> int:
        return sum(self._work)

    def edges(self) -> list[Edge]:
        return [r.edge._replace(start=at, end=at + r.size) for at, (rows, _) in enumerate(self._places) for r in rows]

    def paths(self, top: int | None = None) -> list[Path]:
        """The best paths of the whole text; of equal scores the path that came first."""
        if not self._places:
            return []
        placed: dict[tuple, Edge] = {}
        out = []
        for state in sorted(self._arriving[-1], key=_SCORE, reverse=True)[: self.p.beam][:top]:
            score, at, edges = state[0], len(self._places), []
            while (row := state[1]) is not None:
                start = at - row.size
                if (e := placed.get((start, id(row)))) is None:
                    e = placed[start, id(row)] = row.edge._replace(start=start, end=at)
                edges.append(e)
                at, state = start, state[2]
            edges.reverse()
            out.append(Path(score, tuple(edges)))
        return out


def decode(text: str, p: LatticeParameters) -> Decoded:
    """All edges and the best `beam` paths, left to right."""
    r = Reader(p)
    r.read(text)
    return Decoded(r.edges(), r.paths(), r.expanded)


def competing(scores: list[float], p: LatticeParameters) -> int:
    """How many of the best paths compete: those within the window, but two if there are two."""
    near = sum(scores[0] - x <= p.score_window for x in scores[: p.consensus_paths])
    return max(near, min(2, len(scores)))


def consensus(states: list, p: LatticeParameters) -> tuple[Edge, ...]:
    """The edges that all competing paths begin with; none without competition."""
    near = states[: competing([s[0] for s in states], p)] if states else []
    if len(near) < 2:
        return ()
    while any(s is not near[0] for s in near):
        # a path is one object, so what all begin with is where they meet: the farthest step back
        far = max(s[1].end if s[1] else 0 for s in near)
        near = [s[2] if s[1] and s[1].end == far else s for s in near]
    return _walk(near[0])


class Frame(NamedTuple):
    """What one keystroke left behind."""

    step: int
    input: str
    committed_raw_length: int
    committed_output: str
    active_raw: str
    phonetic_preview: str
    edges: list[Edge]
    paths: list[Path]
    consensus_end: int
    consensus_signature: str
    consensus_stable_frames: int
    commits: list[tuple[int, int, str, str, str]]
    output: str
    expanded_edges: int
    total_expanded_edges: int
    rebuilt: bool


@dataclass
class Session:
    """The incremental form: what is committed is not read again. Frames are returned, not kept.

    nested: whether frames hold edges and paths.
    """

    p: LatticeParameters = field(default_factory=LatticeParameters)
    input: str = ""
    done: int = 0
    said: str = ""
    signature: str = ""
    stable: int = 0
    total: int = 0
    nested: bool = True

    def __post_init__(self):
        self._window = Window(self.p, self.input[self.done :])

    def update(self, text: str) -> list[Frame]:
        """The frames of the characters that text adds; of all of them, marked rebuilt, if it does not continue the input."""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        if bad := [c for c in text if c not in R.ALLOWED]:
            raise ValueError(f"not allowed: {bad[0]!r}")
        again = not text.startswith(self.input)
        if again:
            self.input, self.done, self.said, self.signature, self.stable, self.total = "", 0, "", "", 0, 0
            self._window = Window(self.p)
        return [self._step(c, again) for c in text[len(self.input) :]]

    def _commit(self, edges, why: str) -> list[tuple[int, int, str, str, str]]:
        base = self.done
        self.done, self.said = base + edges[-1].end, self.said + "".join(e.output for e in edges)
        self.signature, self.stable = "", 0
        return [(base + e.start, base + e.end, e.raw, e.output, why) for e in edges]

    def _step(self, c: str, rebuilt: bool) -> Frame:
        self.input += c
        window, commits = self._window, []
        window.add(c)
        active, states, work = window.text, window.finals(), window.expanded
        common = consensus(states, self.p)
        ready = common[0] if common and common[0].end <= len(active) - self.p.lookahead else None
        signature = ":".join(map(str, ready.key)) if ready else ""
        if signature and signature == self.signature:
            self.stable += 1
        else:
            self.signature, self.stable = signature, int(bool(signature))
        cut = 1 + max((i for i, x in enumerate(active) if x in R.BREAKS), default=-1)
        if cut:
            whole = [e for e in _walk(states[0]) if e.end <= cut]
            if whole and whole[-1].end == cut:
                commits = self._commit(whole, "hard-boundary")
        elif ready and self.stable >= self.p.stable_frames:
            commits = self._commit([ready], "multi-hypothesis-prefix-consensus")
        if commits:
            active = self.input[self.done :]
            self._window = window = Window(self.p, active)
            states = window.finals()
            work += window.expanded
        self.total += work
        shown = "".join(e.output for e in _walk(states[0])) if states else ""
        edges, paths, _ = window.decoded() if self.nested else ([], [], 0)
        return Frame(len(self.input), self.input, self.done, self.said, active, R.preview(active), edges, paths, common[-1].end if common else 0, self.signature, self.stable, commits, self.said + shown, work, self.total, rebuilt)
