"""A stream of keystrokes gives the frames of the batch, however it is cut into micro-batches and however late keys are."""

import json
import random
import time

import pandas as pd
import pytest

from mojiweave.plans import lattice as L
from mojiweave.plans import phonetic_first as P
from mojiweave.sources.fixed import ENTRIES
from mojiweave.streaming import runs
from mojiweave.streaming.sessions import KeystrokeProcessor, Lattice, PhoneticFirst, batch_results, decode_batch, decode_stream, results

SCHEMA = "session_id string, seq long, op string, text string"
ROWS = [("a", i, "append", c) for i, c in enumerate("kyouhacommitsimasita")] + [("b", 0, "append", "node"), ("b", 1, "append", ".js=wo"), ("b", 2, "replace", "kyou"), ("b", 2, "zappend", "zzz"), ("b", 3, "append", "ha!")]
KINDS = pytest.mark.parametrize("kind", [Lattice(), PhoneticFirst()], ids=["lattice", "phonetic"])


def streamed(spark, tmp_path, parts, kind, **options):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = decode_stream(source, kind, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def shown(frames):
    """What is shown after each frame of a list in order."""
    now, out = "", []
    for f in frames:
        now = now[: f.kept] + f.shown
        out.append(now)
    return out


@KINDS
def test_stream_equals_batch(spark, tmp_path, kind):
    whole = decode_batch(spark.createDataFrame(ROWS, SCHEMA), kind)
    frames = streamed(spark, tmp_path, (ROWS[:7], ROWS[7:22], ROWS[22:]), kind)
    assert sorted(map(tuple, frames.collect())) == sorted(map(tuple, whole.collect()))
    last = {r.session_id: r.output for r in results(frames).collect()}
    assert last == {"a": "今日はcommitしました", "b": "今日は!"}


@KINDS
def test_late_keystrokes_take_their_place(spark, tmp_path, kind):
    keys = [r for r in ROWS if r[0] == "a"]
    whole = decode_batch(spark.createDataFrame(keys, SCHEMA), kind)
    frames = streamed(spark, tmp_path, (keys[:4] + keys[6:9], keys[4:6] + keys[:1], keys[9:]), kind)
    want = sorted(tuple(r)[3:-1] for r in whole.collect())
    newest = max(r.version for r in frames.collect())
    assert sorted(tuple(r)[3:-1] for r in frames.collect() if r.version == newest) == want and newest == 1
    assert [r.output for r in results(frames).collect()] == [r.output for r in results(whole).collect()] == ["今日はcommitしました"]


@KINDS
def test_a_bounded_log_replays_what_it_holds(spark, tmp_path, kind):
    """Late keystrokes inside the log take their place; one from before it changes nothing and is told."""
    keys = [("a", 10 * i, "append", c) for i, c in enumerate("kyouhacommitsimasita kyouhaii")]
    late, lost = ("a", 255, "append", "desu"), ("a", 5, "append", "xxx")
    frames = streamed(spark, tmp_path, (keys[:9], keys[9:20], keys[20:], [late, lost]), kind, log_keys=4).collect()
    assert [(f.seq, f.step) for f in frames if f.step < 0] == [(5, -1)]
    again = [f for f in frames if f.version == 1 and f.step >= 0]
    assert again and min(f.step for f in again) > 1 and all(f.rebuilt for f in again)
    want = results(decode_batch(spark.createDataFrame([*keys, late], SCHEMA), kind)).collect()
    assert results(spark.createDataFrame(frames)).collect() == want


@KINDS
def test_empty_input(spark, tmp_path, kind):
    rows = [("a", 0, "append", "kyou"), ("a", 1, "replace", ""), ("b", 0, "append", ""), ("b", 1, "append", None), ("c", 0, "replace", None), ("c", 1, "append", "ha"), ("d", 0, "append", "é日")]
    frames = streamed(spark, tmp_path, (rows,), kind)
    assert sorted(map(tuple, frames.collect())) == sorted(map(tuple, decode_batch(spark.createDataFrame(rows, SCHEMA), kind).collect()))
    got = {r.session_id: (r.frames, r.committed_raw_length, r.output, r.total_work) for r in results(frames).collect()}
    assert got["a"] == got["b"] == got["d"] == (0, 0, "", 0) and got["c"][0] == 2 and got["c"][2] == "は"


@KINDS
def test_a_repeated_text_and_edits(spark, kind):
    """The same text again adds no frame, one that goes on adds the rest, one that does not starts anew."""
    rows = [("a", 0, "append", "kyou"), ("a", 1, "replace", "KYOU"), ("a", 2, "replace", "kyouha"), ("a", 3, "replace", "kyo"), ("a", 4, "append", "to")]
    frames = sorted(decode_batch(spark.createDataFrame(rows, SCHEMA), kind).collect(), key=lambda f: (f.version, f.step))
    assert [(f.seq, f.version, f.step, f.rebuilt) for f in frames] == [(0, 0, 0, False), *((0, 0, k, False) for k in (1, 2, 3, 4)), (2, 0, 5, False), (2, 0, 6, False), (3, 1, 0, True), *((3, 1, k, True) for k in (1, 2, 3)), (4, 1, 4, False), (4, 1, 5, False)]
    one = kind.start()
    want = shown([f for f in frames if f.version == 1])[-1]
    now = ""
    for _, _, kept, text, *_ in kind.rows(one, "kyoto"):
        now = now[:kept] + text
    assert now == want == results(spark.createDataFrame(frames)).first().output


def test_stopped_and_restarted(spark):
    folder = runs.new_folder(spark)
    keys = spark.createDataFrame(ROWS, SCHEMA)
    runs.deliver(keys.filter("seq % 2 = 0"), folder)
    first = results(runs.catch_up(spark, folder)).collect()
    assert results(runs.catch_up(spark, folder)).collect() == first  # nothing new
    runs.deliver(keys, folder)
    got = {r.session_id: r.output for r in results(runs.catch_up(spark, folder, ttl_ms=None)).collect()}
    assert got == {"a": "今日はcommitしました", "b": "今日は!"}


def test_frames_hold_what_the_sessions_hold(spark):
    text = "kyouhacommitsimasita. node.jswotukau"
    rows = [("x", i, "append", c) for i, c in enumerate(text)]
    got = decode_batch(spark.createDataFrame(rows, SCHEMA)).orderBy("step").collect()
    assert shown(got)[1:] == [f.output for f in L.Session().update(text)]
    got = decode_batch(spark.createDataFrame(rows, SCHEMA), PhoneticFirst()).orderBy("step").collect()
    assert shown(got)[1:] == [s.output for s in P.PhoneticSession().update(text)]


def random_text(rng):
    words = [e.raw for e in ENTRIES] + ["purchase", "view", "node.js", "c++", "kyou", "n", "kk", "zq", "1", "(", "foo_bar"]
    return "".join(rng.choice(words) + rng.choice(["", " ", "", "", ", ", "。", "("]) for _ in range(rng.randrange(1, 9)))


def test_changes_are_those_of_whole_steps():
    """Saved and loaded at any place, keys() gives the outputs, lengths and work of steps()."""
    rng = random.Random(2)
    for _ in range(120):
        text = random_text(rng)
        s, out = P.PhoneticSession(), ""
        for c, f in zip(text, P.PhoneticSession().update(text), strict=True):
            if rng.random() < 0.2:
                s = P.PhoneticSession.loaded(s.p, json.loads(json.dumps(s.saved())))
            (change,) = s.keys(c)
            out = out[: change.kept] + change.shown
            assert (out, change.step, change.hard_raw_length, change.analyzed, change.total_analyzed) == (f.output, f.step, f.hard_raw_length, f.analyzed, f.total_analyzed), text


def test_pieces_read_as_the_whole():
    """Reading piece by piece is reading as a whole: tokens, anchors and gaps over the whole text give the same segments."""
    rng, p = random.Random(7), P.PhoneticParameters()
    for _ in range(300):
        text = random_text(rng)
        assert P.resolve(text, p) == P._resolve_piece(text, p, True), text


@pytest.mark.parametrize("text", ["view purchase click signup error ", "kyouhacommitsimasita"])
def test_a_session_takes_time_in_proportion_to_its_length(text):
    def took(n):
        s, began = P.PhoneticSession(), time.process_time()
        for _ in s.keys((text * (n // len(text) + 1))[:n]):
            pass
        return time.process_time() - began

    took(500)
    assert took(8000) < 4 * 3 * took(2000) + 0.5


@KINDS
def test_batch_results_are_those_of_the_frames(spark, kind):
    rng, words = random.Random(11), ["view ", "click ", "purchase ", "kyouha", "commit", "n", "", ".js", "wotukau ", "A b!"]
    rows = [(str(s), q, "replace" if rng.random() < 0.08 else "append", rng.choice(words)) for s in range(40) for q in range(30)] + [("0", 3, "append", "zz"), ("e", 0, None, None)]
    keys = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, batch_results(keys, kind).collect())) == sorted(map(tuple, results(decode_batch(keys, kind)).collect()))


@KINDS
def test_states_that_recur_are_read_once(kind, monkeypatch):
    """Frames do not depend on what a worker remembers, nor on saving and loading in between; known texts are not typed again."""
    from mojiweave.streaming import sessions

    rng, words = random.Random(5), ["view ", "click ", "purchase ", "signup ", "kyouhacommit", "wo", "x-y ", "c++"]
    runs_ = [[rng.choice(words) for _ in range(40)] for _ in range(25)]

    def frames(longest, reload=False):
        monkeypatch.setattr(sessions, "LONGEST", longest)
        sessions._known.cache_clear()
        out = []
        for texts in runs_:
            x = kind.start()
            for i, t in enumerate(texts):
                out += list(kind.rows(x, t))
                if reload and i % 7 == 3:
                    x = kind.load(json.loads(json.dumps(kind.save(x))))
        return out

    want = frames(-1)  # nothing is remembered
    assert frames(sessions.LONGEST if sessions.LONGEST > 0 else 96) == frames(96, True) == want
    x, y = kind.start(), kind.start()
    for z in (x, y):
        for _ in range(30):
            list(kind.rows(z, "view "))
    assert y.live is None


class _Map:
    def __init__(self):
        self.held, self.writes = {}, 0

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key], self.writes = value, self.writes + 1

    def removeKey(self, key):
        del self.held[key]


class _Handle:
    def __init__(self):
        self.maps = {}

    def getMapState(self, name, key, value, ttl):
        return self.maps.setdefault(name, _Map())


@KINDS
def test_what_state_and_frames_cost_does_not_grow_with_keystrokes(kind):
    """Sessions of a bucket that come together give one table of frames; each has one write of its state, and one of its log for all its keystrokes."""
    handle, processor = _Handle(), KeystrokeProcessor(kind, log_keys=40, ttl_ms=None)
    processor.init(handle)
    rows = [(s, i, "append", "ha") for i in range(60) for s in ("a", "b", None)]
    first, late = ([r for r in rows if (r[1] < 50 and r[1] % 10 != 0) == early] for early in (True, False))
    for n, part in enumerate((first, late), 1):
        tables = list(processor.handleInputRows((7,), iter([pd.DataFrame(part[i : i + 70], columns=["session_id", "seq", "op", "text"]) for i in range(0, len(part), 70)]), None))
        assert len(tables) == 1 and set(tables[0].session_id) == {"a", "b", None}
        assert [handle.maps[x].writes for x in ("session", "log")] == [3 * n, 3 * n]
    ends = {s: (f.step, f.version) for s, f in zip(tables[0].session_id, tables[0].itertuples(), strict=True)}
    assert ends == {s: (120, 1) for s in ("a", "b", None)}
    list(processor.handleInputRows((7,), iter([pd.DataFrame([("a", i, "append", "ha") for i in range(60, 90)], columns=["session_id", "seq", "op", "text"])]), None))
    assert len([k for k in handle.maps["log"].held if k[0] == "a"]) == 1 and handle.maps["session"].held[("a",)][2] == 40  # the log was cut


@KINDS
def test_one_bucket_and_a_session_without_a_name(spark, tmp_path, kind):
    rows = [*ROWS, (None, 0, "append", "kyou"), (None, 1, "append", "ha")]
    whole = sorted(map(repr, map(tuple, decode_batch(spark.createDataFrame(rows, SCHEMA), kind).collect())))
    frames = streamed(spark, tmp_path, (rows[:7], rows[7:22], rows[22:]), kind, buckets=1)
    assert sorted(map(repr, map(tuple, frames.collect()))) == whole
