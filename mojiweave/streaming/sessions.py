"""Keystroke sessions as a stream: one state per session, one frame per keystroke.

Input: session_id string, seq long, op string ('append' adds text, 'replace' replaces the whole
input), text string. A session's rows are taken by seq; of rows with one seq the first to arrive
counts, of those that arrive together the least by op and text. Characters that are not allowed are dropped, as in an editor.

A frame is a change: of what was shown before, `kept` characters stay, and `shown` follows them, so its
size does not grow with the session. Frames of step 0 begin a session, or begin it anew after an
edit that does not continue the input; that starts a new version. A keystroke that arrives after
later ones is put in its place: the session is read anew from its log, and the frames from
there on are emitted again under a new version. results() puts frames together.

State: for each session, what the next keystroke needs, and a log. The log holds the last `log_keys` keystrokes, twice as
many at most, and what the session was before them; a keystroke from before the log gets a frame
of step -1 and changes nothing. With ttl_ms, state that was not touched for so long is forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mojiweave.plans import lattice as L
from mojiweave.plans import phonetic_first as P
from mojiweave.plans import reading as R
from mojiweave.sources.fixed import LatticeParameters

OUT = "session_id string, seq long, version int, step int, committed_raw_length int, kept int, shown string, work long, total_work long, rebuilt boolean"
NAMES = [x.split()[0] for x in OUT.split(", ")]
#: A block of the log: keystrokes that came together, as JSON of [seq, op, text], BLOCK_KEYS of them at most. What state costs, it costs for each row.
LOG = "keys string"
BLOCK_KEYS = 500
#: Sessions that share a bucket come to Python together, and so do their frames: what a group costs, it costs once for all of them.
BUCKETS = 1024
#: Keystrokes of a session that a late one may precede, at least.
LOG_KEYS = 1000
_LOWER = {i: i + 32 for i in range(65, 91)}


def clean(text: str | None) -> str:
    return "".join([c for c in (text or "").translate(_LOWER) if c in R.ALLOWED])


def _frame_table(frames: list[tuple]) -> pd.DataFrame:
    """Frames with typed columns, so that pandas need not look at each value."""
    types = object, "int64", "int32", "int32", "int32", "int32", object, "int64", "int64", "bool"
    columns = zip(*frames, strict=True) if frames else [()] * len(NAMES)
    return pd.DataFrame({n: np.array(c, t) for n, c, t in zip(NAMES, columns, types, strict=True)})


#: What a worker remembers: states, each with a text typed on it, and the longest of them (more recur seldom).
KNOWN, LONGEST = 50_000, 96


@lru_cache(maxsize=8)
def _known(kind: str, p) -> dict:
    """What texts do to states that recur: (state, text) -> frames and the state after, all counted from the state's own beginning. Lives as long as the worker."""
    return {}


def _remember(known: dict, key: tuple, value: tuple) -> tuple:
    if len(known) >= KNOWN:
        known.clear()
    known[key] = value
    return value


class _LatticeState:
    """A lattice session without what it has said, of which only the length counts; open: the input that is not committed, the consensus so far, and what is shown of it.

    live: the session itself, unless the last text was one that is known.
    """

    def __init__(self, text: str, done: int, total: int, said: int, open_: tuple):
        self.input, self.done, self.total, self.said, self.open = text, done, total, said, open_
        self.live: L.Session | None = None


class Lattice:
    """The evidence lattice."""

    def __init__(self, p: LatticeParameters | None = None):
        self.p = p or LatticeParameters()

    def start(self):
        return _LatticeState("", 0, 0, 0, ("", "", 0, ""))

    def save(self, x: _LatticeState) -> list:
        _, signature, stable, shown = x.open
        return [x.input, x.done, signature, stable, x.total, x.said, shown]

    def load(self, saved: list):
        text, done, signature, stable, total, said, shown = saved
        return _LatticeState(text, done, total, said, (text[done:], signature, stable, shown))

    def _typed(self, x: _LatticeState, text: str) -> tuple:
        """Frames and the state after, counted from where x's open part begins."""
        active, signature, stable, shown = x.open
        s = x.live = x.live or L.Session(self.p, active, 0, "", signature, stable, 0, nested=False)
        begin, total, said, frames = s.done, s.total, 0, []
        s.said = ""
        for f in s.update(s.input + text):
            committed, rest = "".join(c[3] for c in f.commits), f.output[len(f.committed_output) :]
            now, n = committed + rest, 0
            while n < min(len(now), len(shown)) and now[n] == shown[n]:
                n += 1
            frames.append((f.step - begin, f.committed_raw_length - begin, said + n, now[n:], f.expanded_edges, f.total_expanded_edges - total))
            said, shown = said + len(committed), rest
        return tuple(frames), (s.input[s.done :], s.signature, s.stable, shown), s.done - begin, s.total - total, said

    def rows(self, x: _LatticeState, text: str) -> Iterator[tuple]:
        known, key = _known("lattice", self.p), (x.open, text)
        got = known.get(key)
        if got is not None:
            x.live = None
        elif len(x.open[0]) + len(text) > LONGEST:
            got = self._typed(x, text)
        else:
            got = _remember(known, key, self._typed(x, text))
        frames, open_, done, total, said = got
        for f in frames:
            yield x.done + f[0], x.done + f[1], x.said + f[2], f[3], f[4], x.total + f[5]
        x.input, x.open, x.done, x.total, x.said = x.input + text, open_, x.done + done, x.total + total, x.said + said


class _PhoneticState:
    """A phonetic-first session of which the hard part is one number of characters; open: the input after it and its soft segments, in places of their own, or what a settled session depends on.

    live: the session itself, unless the last text was one that is known.
    """

    def __init__(self, text: str, hard: int, chars: int, total: int, open_: tuple, before: int = 0):
        self.input, self.hard, self.chars, self.total, self.open, self.before = text, hard, chars, total, open_, before
        self.live: P.PhoneticSession | None = None


class PhoneticFirst:
    """The phonetic-first session; committed is what is frozen hard."""

    def __init__(self, p: P.PhoneticParameters | None = None):
        self.p = p or P.PhoneticParameters()

    def start(self):
        return _PhoneticState("", 0, 0, 0, ("", ()))

    def save(self, x: _PhoneticState) -> list:
        soft = x.open[1] if len(x.open) == 2 else ()
        return [x.input, x.hard, x.chars, [[x.hard + a, x.hard + b, *rest] for a, b, *rest in soft], x.total]

    def load(self, saved: list):
        text, hard, chars, soft, total = saved
        return _PhoneticState(text, hard, chars, total, (text[hard:], tuple((a - hard, b - hard, *rest) for a, b, *rest in soft)))

    def _session(self, x: _PhoneticState) -> P.PhoneticSession:
        if x.live is None:
            soft = x.open[1] if len(x.open) == 2 else ()
            x.live = P.PhoneticSession.loaded(self.p, [x.input[x.hard :], 0, 0, soft, 0])
        return x.live

    def _after(self, s: P.PhoneticSession) -> tuple:
        if (settled := s.settled) is not None:
            return settled
        at = s.hard
        return s.input[at:], tuple((a - at, b - at, *rest) for a, b, *rest in s.committed[s.n_hard :])

    def _typed(self, x: _PhoneticState, text: str) -> tuple:
        """Frames and the state after, counted from where x's open part begins."""
        s = self._session(x)
        _, at, chars, _, total = s.saved()
        frames = tuple((f[0] - at, f[1] - at, f[2] - chars, f[3], f[4], f[5] - total) for f in s.keys(text))
        _, hard, after, _, sum_ = s.saved()
        return frames, self._after(s), hard - at, after - chars, sum_ - total, s.shown_before - after

    def _settled(self, x: _PhoneticState, text: str) -> tuple:
        """The same of a settled session: (kept, shown) of each keystroke and the state after, counted from where the last piece is shown."""
        s = self._session(x)
        before = s.shown_before
        frames = tuple((f[2] - before, f[3]) for f in s.keys(text))
        return frames, self._after(s), s.shown_before - before

    def rows(self, x: _PhoneticState, text: str) -> Iterator[tuple]:
        settled = len(x.open) == 3
        known, key = _known("phonetic", self.p), (x.open, text)
        got = known.get(key)
        if got is not None:
            x.live = None
        else:
            got = (self._settled if settled else self._typed)(x, text)
            if len(x.open[0]) + len(text) <= LONGEST and (not settled or len(got[1]) == 3):
                _remember(known, key, got)
        if settled:
            frames, open_, moved = got
            n, hard, total = len(x.input), x.hard, x.total
            for kept, shown in frames:
                n += 1
                total += n - hard
                yield n, hard, x.chars + x.before + kept, shown, n - hard, total
            x.open, x.total, x.before = open_, total, x.before + moved
        else:
            frames, open_, hard, chars, total, before = got
            for f in frames:
                yield x.hard + f[0], x.hard + f[1], x.chars + f[2], f[3], f[4], x.total + f[5]
            x.open, x.hard, x.chars, x.total, x.before = open_, x.hard + hard, x.chars + chars, x.total + total, before
        x.input += text


def _advance(kind, session, version: int, op: str, text: str):
    """(session, version, frames without ids) after one row."""
    text, frames, rebuilt = clean(text), [], False
    if op == "replace":
        if text.startswith(session.input):
            text = text[len(session.input) :]
        else:
            session, version, rebuilt = kind.start(), version + 1, True
            frames.append((0, 0, 0, "", 0, 0, True))
    frames += [(*f, rebuilt) for f in kind.rows(session, text)]
    return session, version, frames


_BEGIN = (0, 0, 0, "", 0, 0, False)


class KeystrokeProcessor(StatefulProcessor):
    """Of the sessions of a bucket: each has its own entries in maps of state, so a bucket is never read or written whole."""

    def __init__(self, kind, log_keys: int, ttl_ms: int | None):
        self._kind, self._keep, self._ttl = kind, log_keys, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # base: the session before the log's keystrokes and the seq of the last one in it; the log is the blocks from first to before next
        self._state = handle.getMapState("session", "session string", "last long, version int, logged int, first long, next long, base long, before string, saved string", self._ttl)
        self._log = handle.getMapState("log", "session string, block long", LOG, self._ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        typed: dict[str, dict[int, tuple[str, str]]] = {}
        for part in rows:
            for sid, seq, op, text in zip(*(part[c].tolist() for c in ("session_id", "seq", "op", "text")), strict=True):
                new, q, x = typed.setdefault(sid, {}), int(seq), (op or "", text or "")
                new[q] = min(x, new.get(q, x))
        out = []
        while typed:
            out += self._frames(*typed.popitem())
            if len(out) >= 10_000 or not typed:
                yield _frame_table(out)
                out = []

    def _frames(self, sid: str, new: dict[int, tuple[str, str]]) -> list[tuple]:
        """The frames of what a session was sent."""
        kind, out = self._kind, []
        last = base = before = None
        version = logged = first = end = 0
        if (held := self._state.getValue((sid,))) is not None:
            last, version, logged, first, end, base, before, saved = held
            session = kind.load(json.loads(saved))
        else:
            session = kind.start()
            out.append((sid, min(new), version, *_BEGIN))
        out += [(sid, seq, version, -1, 0, 0, "", 0, 0, False) for seq in sorted(new) if base is not None and seq <= base]
        new = {q: x for q, x in new.items() if base is None or q > base}
        todo, again = new, False
        if last is not None and any(q <= last for q in new):
            log = self._logged(sid, first, end)
            todo = new = {q: x for q, x in new.items() if q not in log}
            if any(q <= last for q in new):
                todo, again, version = log | new, True, version + 1
                session = kind.load(json.loads(before)) if before else kind.start()
                if not before:
                    out.append((sid, min(todo), version, *_BEGIN))
        for seq in sorted(todo):
            session, version, frames = _advance(kind, session, version, *todo[seq])
            out += [(sid, seq, version, *f[:-1], f[-1] or again) for f in frames]
        end = self._write(sid, end, sorted(new.items()))
        logged += len(new)
        if logged > 2 * self._keep:
            log = sorted(self._logged(sid, first, end).items())
            old = kind.load(json.loads(before)) if before else kind.start()
            for _, x in log[: -self._keep]:
                old = _advance(kind, old, 0, *x)[0]
            before, base, logged = json.dumps(kind.save(old), ensure_ascii=False), log[-self._keep - 1][0], self._keep
            for block in range(first, end):
                self._log.removeKey((sid, block))
            first, end = end, self._write(sid, end, log[-self._keep :])
        seen = [q for q in (last, *new) if q is not None]
        self._state.updateValue((sid,), (max(seen) if seen else None, version, logged, first, end, base, before, json.dumps(kind.save(session), ensure_ascii=False)))
        return out

    def _write(self, sid: str, block: int, keys: list[tuple]) -> int:
        """Writes keystrokes as blocks of the log, from `block` on; the number after the last."""
        for i in range(0, len(keys), BLOCK_KEYS):
            self._log.updateValue((sid, block), (json.dumps([(q, *x) for q, x in keys[i : i + BLOCK_KEYS]], ensure_ascii=False),))
            block += 1
        return block

    def _logged(self, sid: str, first: int, end: int) -> dict[int, tuple[str, str]]:
        blocks = (self._log.getValue((sid, i)) for i in range(first, end))
        return {q: (op, text) for b in blocks if b is not None for q, op, text in json.loads(b[0])}

    def close(self) -> None:
        pass


def decode_stream(keys: DataFrame, kind=None, log_keys: int = LOG_KEYS, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Frames of a stream of keystrokes, of a Lattice or a PhoneticFirst. Needs the RocksDB state store provider; buckets stay the same for a checkpoint."""
    processor = KeystrokeProcessor(kind or Lattice(), log_keys, ttl_ms)
    dealt = keys.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="append", timeMode="processingTime" if ttl_ms else "none")


def _in_turn(keys: DataFrame) -> DataFrame:
    """Keystrokes with each session's together and in order; few bytes and much work, so they are dealt by the number of cores."""
    ordered = keys.select("session_id", "seq", F.coalesce("op", F.lit("")).alias("op"), F.coalesce("text", F.lit("")).alias("text"))
    return ordered.repartition(4 * keys.sparkSession.sparkContext.defaultParallelism, "session_id").sortWithinPartitions("session_id", "seq", "op", "text")


def decode_batch(keys: DataFrame, kind=None) -> DataFrame:
    """The same frames of a finished table of keystrokes; a session's rows are read in order from sorted partitions."""
    kind = kind or Lattice()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, session, last, version = None, None, None, 0
        for batch in frames:
            out = []
            for sid, seq, op, text in batch[["session_id", "seq", "op", "text"]].itertuples(index=False):
                if sid != now or session is None:
                    now, session, last, version = sid, kind.start(), None, 0
                    out.append((sid, int(seq), version, *_BEGIN))
                if last is not None and seq <= last:
                    continue
                last = seq
                session, version, made = _advance(kind, session, version, op, text)
                out += [(sid, int(seq), version, *f) for f in made]
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=NAMES)
                    out = []
            yield pd.DataFrame(out, columns=NAMES)

    return _in_turn(keys).mapInPandas(run, OUT)


def batch_results(keys: DataFrame, kind=None) -> DataFrame:
    """results(decode_batch(keys, kind)) without its frames: a session's keystrokes are put together as they are read."""
    kind = kind or Lattice()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("session_id", pa.string()), ("frames", pa.int64()), ("committed_raw_length", pa.int32()), ("output", pa.string()), ("total_work", pa.int64())])
        now, session, last, shown, told, out = None, None, None, "", (0, 0, 0), []

        def made(rows: list):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], schema=kinds)

        for batch in batches:
            for sid, seq, op, text in zip(*(batch.column(c).to_pylist() for c in ("session_id", "seq", "op", "text")), strict=True):
                if sid != now or session is None:
                    if session is not None:
                        out.append((now, told[0], told[1], shown, told[2]))
                    now, session, last, shown, told = sid, kind.start(), None, "", (0, 0, 0)
                    if len(out) >= 5_000:
                        yield made(out)
                        out = []
                if last is not None and seq <= last:
                    continue
                last = seq
                session, _, frames = _advance(kind, session, 0, op, text)
                if not frames:
                    continue
                least = min(f[2] for f in frames)
                tail = shown[least:]
                for f in frames:
                    tail = tail[: f[2] - least] + f[3]
                shown, told = shown[:least] + tail, (frames[-1][0], frames[-1][1], frames[-1][5])
        if session is not None:
            out.append((now, told[0], told[1], shown, told[2]))
        yield made(out)

    return _in_turn(keys).mapInArrow(run, "session_id string, frames long, committed_raw_length int, output string, total_work long")


def current(frames: DataFrame) -> DataFrame:
    """The frames that later versions have not taken back."""
    later = Window.partitionBy("session_id").orderBy(F.desc("version")).rangeBetween(Window.unboundedPreceding, -1)
    valid = frames.filter("step >= 0").withColumn("_from", F.min("step").over(later))
    return valid.filter("_from is null or step < _from").drop("_from")


def results(frames: DataFrame) -> DataFrame:
    """(session_id, frames, committed_raw_length, output, total_work) of each session as its frames leave it."""
    # from the last on: a frame that only grows is folded once, one that only shrinks anew for each row
    after = Window.partitionBy("session_id").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    stays: Column = F.coalesce(F.min("kept").over(after) - F.col("kept"), F.length("shown"))
    parts = current(frames).withColumn("_left", F.substr("shown", F.lit(1), F.greatest(stays, F.lit(0))))
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("_left") != "", F.struct("step", "_left")))), lambda x: x["_left"])
    own = parts.groupBy("session_id").agg(F.count_if(F.col("step") > 0).alias("frames"), said.alias("said"), F.max_by(F.struct("committed_raw_length", "total_work"), "step").alias("last"))
    return own.select("session_id", "frames", F.col("last.committed_raw_length").alias("committed_raw_length"), F.array_join("said", "").alias("output"), F.col("last.total_work").alias("total_work"))
