"""Golden sentences, combinations, fuzz and invariants of the three generations."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from mojiweave.operators import consensus, lattice, orthography, phonetic_sessions, quality, reports
from mojiweave.plans import lattice as L
from mojiweave.plans import phonetic_first as P
from mojiweave.sources import export
from mojiweave.sources.fixed import LatticeParameters
from mojiweave.sources.tables import lexicon

LATTICE = {
    "kyouhacommitsimasita": "今日はcommitしました",
    "kyouissueha": "今日issueは",
    "kyoudebugni": "今日debugに",
    "node.jswotukau": "node.jsを使う",
    "demotyottomonndainanoganode.jstoiukotoba": "でもちょっともんだいなのがnode.jsということば",
    "hennkannnikannsitehacommittokanoeigoiretemondainasasoudane demotyottomonndainanoganode.jstoiukotobagabunnkatudekitenainndayone": "へんかんにかんしてはcommitとかのえいごいれてもんだいなさそうだね でもちょっともんだいなのがnode.jsということばがぶんかつできてないんだよね",
    "animeha": "アニメは",
    "repoha": "れぽは",
}
PHONETIC = {
    "kyouhacommitsimasita": "今日はcommitしました",
    "seidohasugokuiikannzininattakaramethodtositehakonnnakannzideiikamo": "精度はすごくいい感じになったからmethodとしてはこんな感じでいいかも",
    "node.js": "node.js",
    "node.jswotukau": "node.jsを使う",
    "mawasu": "まわす",
    "foo_bar": "foo_bar",
    "c#": "c#",
    "v2.0": "v2.0",
    "github.com": "github.com",
    "kyouzyuunitaiousiteoitayo": "今日じゅうにたいおうしてをいたよ",
}


@pytest.mark.parametrize("text,expected", LATTICE.items())
def test_lattice_sentences(text, expected):
    frames = L.Session().update(text)
    assert frames[-1].output == expected
    assert len(frames) == len(text)
    assert all(len(f.paths) <= 16 for f in frames)


@pytest.mark.parametrize("text,expected", PHONETIC.items())
def test_phonetic_sentences(text, expected):
    assert P.PhoneticSession().update(text)[-1].output == expected


def test_typing_equals_pasting_and_edits_rebuild():
    text, typed = "hennkannnikannsitehacommitnode.jswotukau", L.Session()
    frames = [f for i in range(len(text)) for f in typed.update(text[: i + 1])]
    assert frames == L.Session().update(text)
    assert typed.update(text) == []
    again = typed.update("kyouha")
    assert len(again) == 6 and all(f.rebuilt for f in again) and again[-1].output == "今日は"
    with pytest.raises(ValueError):
        typed.update("a=b")


def test_kept_paths_are_those_of_a_fresh_reading():
    for text in [*LATTICE, *fuzz(150), "a+++b", "c++", "x#y", "go+to++c"]:
        for f in L.Session().update(text):
            got = L.decode(f.active_raw, LatticeParameters())
            assert (f.edges, f.paths) == (got.edges, got.paths), (text, f.step)
            assert f.edges == L.candidate_edges(f.active_raw, LatticeParameters())


def test_texts_in_order_share_what_they_begin_with():
    p, read = LatticeParameters(), []
    r = L.Reader(p)
    place = r._read_place
    r._read_place = lambda text: read.append(text) or place(text)
    texts = sorted([*LATTICE, *fuzz(150), "a+++b", "c++", "ab" + "+" * 40 + "wakyou", "x+" * 20, "abcdefghijkl.kyouhawotukau", ""])
    for text in [*texts, *reversed(texts)]:
        r.read(text)
        w = L.Window(p, text)
        assert (r.edges(), r.paths(), r.expanded) == tuple(w.decoded()), text
        assert r.paths(1) == w.decoded().paths[:1]
    read.clear()
    for n in range(200):
        r.read(f"https://blog.example.org/en/{n:03}?utm_source=feed")
    assert len(read) < 200 * 12


def test_paths_are_counted_as_edges_are_checked(spark):
    good, e = lattice.decode(spark.createDataFrame([(t,) for t in fuzz(40)], "text string"), fields=("start", "end", "raw")), "array<struct<start:int,end:int,raw:string>>"
    odd = spark.createDataFrame([("abc", 1, [(0, 1, "a"), (2, 3, "c")]), ("abc", 2, [(0, 2, "ab")]), ("abc", 3, [(0, 1, "b"), (1, 3, "bc")]), ("abc", 4, [(1, 3, "bc")])], f"text string, rank int, edges {e}")
    for paths in (good.select("text", "rank", "edges"), odd):
        checked = quality.checked_paths(lattice.explode_edges(paths)).groupBy("text", "rank").agg(F.count(F.lit(1)).alias("edges"), F.count_if("bad").alias("broken"))
        assert sorted(checked.collect()) == sorted(quality.counted_paths(paths).collect())
    assert [r.broken for r in quality.counted_paths(odd).orderBy("rank").collect()] == [1, 1, 1, 1]


def test_sessions_in_order_are_typed_once_for_what_they_begin_with(spark):
    p, texts = P.PhoneticParameters(), sorted([*PHONETIC, *LATTICE, *fuzz(200), "kyouhaq", "harucommit"])
    typing, typed = P.Typing(p, bare=True), []
    for text in [*texts, *reversed(texts)]:
        s, whole = typing.type(text), P.PhoneticSession(p).update(text)
        last = whole[-1]
        assert (typing.output(), s.done, s.hard, s.total) == (last.output, last.committed_raw_length, last.hard_raw_length, last.total_analyzed), text
        plain = [x._replace(segments=[(y.start, y.end, y.raw, y.output) for y in x.segments], preview="", marks=[], ripples=[]) for x in whole]
        assert [x._replace(segments=[(y.start, y.end, y.raw, y.output) for y in x.segments]) for x in typing.steps()] == plain
    step = P.PhoneticSession._key
    try:
        P.PhoneticSession._key = lambda self, c, watch: typed.append(c) or step(self, c, watch)
        for n in range(100):
            typing.type(f"https://blog.example.org/en/{n:03}")
    finally:
        P.PhoneticSession._key = step
    assert len(typed) < 28 + 100 * 3
    df = spark.createDataFrame([(t,) for t in [*texts, ""]], "text string")
    steps = phonetic_sessions.phonetic_steps(df).cache()
    names = ("text", "output", "committed_raw_length", "hard_committed_raw_length", "total_analyzed")
    assert sorted(phonetic_sessions.results(df).collect()) == sorted(phonetic_sessions.last_steps(steps).select(*names).collect())
    checked = [x.groupBy("text").agg(F.count(F.lit(1)), F.max(F.length("input")), F.count_if("bad")) for x in map(phonetic_sessions.checked_steps, (steps, phonetic_sessions.bare_steps(df)))]
    assert sorted(checked[0].collect()) == sorted(checked[1].collect())


def test_no_early_particle_commit():
    s = L.Session()
    s.update("henn")
    assert s.done == 0
    frames = L.Session().update("hennkann")
    assert all(c[:2] != (0, 2) or c[3] != "へ" for f in frames for c in f.commits)


def test_structural_token_leaves_the_japanese_before_it():
    last = L.Session().update("demotyottomonndainanoganode.jstoiukotoba")[-1]
    assert not any(e.kind == "LatinStructural" and e.raw.startswith("demo") for e in last.paths[0].edges)


def test_phonetic_flags():
    assert any(f.thaws for f in P.PhoneticSession().update("kyouhaq"))
    assert any(r.kind == "LowConfidenceSegment" for f in P.PhoneticSession().update("harucommit") for r in f.ripples)
    node = P.PhoneticSession().update("node.js")
    assert node[-1].segments[0].reason == "stage2-orthographic-latin-token"
    assert {"LatinBindingToken", "IncompleteBindingToken"} <= {m[3] for f in node for m in f.marks}
    assert not any(s.raw == "wa" and s.reason == "stage2-japanese-particle" for s in P.PhoneticSession().update("mawasu")[-1].segments)
    end = P.PhoneticSession().update("kyouhaame!")[-1]
    assert end.output.endswith("!") and any(m[3] == "HardBoundary" for m in end.marks)
    work = P.PhoneticSession().update("seidohasugokuiikannzininattakaramethodtositehakonnnakannzideiikamo")[-1].total_analyzed
    assert work < 0.8 * 66 * 67 / 2


def test_mixed_and_binding_corpora():
    ja = dict(kyou="今日", asita="明日", nihongo="日本語", watasi="私", seido="精度", sugoku="すごく", kannzi="感じ", natta="なった", nado="など", suru="する")
    suffix = dict(ha="は", de="で", ni="に", wo="を", suru="する")
    english = "commit issue github linux kernel network server cache debug method".split()
    for a, b, c in itertools.product(ja, english, suffix):
        assert P.PhoneticSession().update(a + b + c)[-1].output == ja[a] + b + suffix[c]
    left, right = "node foo bar alpha beta pkg lib api github sample v2 net8".split(), "js core test dev com io 0 1 api".split()
    for a, x, b in itertools.product(left, "._-@/:", right):
        frames = P.PhoneticSession().update(a + x + b)
        assert frames[-1].output == a + x + b and any(m[3] == "LatinBindingToken" for f in frames for m in f.marks)
    for token in ("c#", "c++", "f#", "x#", "lib+", "pkg++"):
        assert P.PhoneticSession().update(token)[-1].output == token


def xorshift(seed: int):
    x = seed or 0x9E3779B9
    while True:
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        yield x


def fuzz(n: int) -> list[str]:
    draw, letters = xorshift(0xC0FFEE42), "abcdefghijklmnopqrstuvwxyz0123456789._-+#@/:,;!?()[]{}\"' "
    return ["".join(letters[next(draw) % len(letters)] for _ in range(1 + next(draw) % 48)) for _ in range(n)]


def test_fuzz_invariants(spark):
    texts = spark.createDataFrame([(t,) for t in fuzz(400)], "text string")
    steps = phonetic_sessions.phonetic_steps(texts).cache()
    assert phonetic_sessions.broken_steps(steps).isEmpty()
    assert quality.frame_counts(steps).filter("frames != characters").isEmpty()
    frames = lattice.session_frames(texts, nested=True).cache()
    assert quality.broken_frames(frames).isEmpty()
    assert quality.frame_counts(frames).filter("frames != characters").isEmpty()
    assert quality.beam_widths(frames).filter("widest > 16").isEmpty()
    assert quality.broken_paths(lattice.explode_edges(lattice.decode(texts))).isEmpty()
    a, b = (quality.signature(lattice.session_frames(texts), "text") for _ in range(2))
    assert a.exceptAll(b).isEmpty()


def test_consensus_chooses_and_confirms(spark):
    frames, bounds, segments = consensus.analyze(spark.createDataFrame([("kyouhacommitsimasita",), ("a b",)], "text string"), lexicon(spark))
    last = frames.filter("step = 20").collect()
    assert [r["output"] for r in last] == ["今日はcommitしました"]
    chosen = segments.filter("step = 20").orderBy("start").collect()
    assert [r["raw"] for r in chosen] == ["kyou", "ha", "commit", "simasita"]
    assert [r["confirmed"] for r in chosen] == [True, True, True, False]
    rows = bounds.filter("step = 20").collect()
    assert all(r["stability"] is None for r in rows if r["position"] >= 18)
    assert all(0 <= r["beam"] <= 1 + 1e-9 for r in rows)


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("node.jswotukau", [("node.js", "LatinBindingToken")]),
        ("node.core", [("node.core", "LatinBindingToken")]),
        ("foo.", [("foo.", "IncompleteBindingToken")]),
        ("c++!", [("c++", "LatinBindingToken"), ("+", "BindingSymbol"), ("!", "HardBoundary")]),
        ("(a)", [("(", "NeutralSymbol"), (")", "NeutralSymbol")]),
        (". x", [(".", "BindingSymbol"), (" ", "HardBoundary")]),
    ],
)
def test_orthography(text, kinds):
    assert [(r, k) for _, _, r, k, *_ in orthography.evidence(text)] == kinds


def test_documents(spark, tmp_path):
    rows = lattice.session_frames(spark.createDataFrame([("kyouha",)], "text string"), nested=True).filter("step = 6")
    made = export.as_document(rows, "lattice", "v", lattice.parameter_row(LatticeParameters()), "text")
    body = json.loads(made.first()["json"])
    assert {"formatVersion", "algorithmVersion", "parameters", "topPaths", "candidateEdges", "commitEvents"} <= set(body)
    assert body["parameters"]["scoreWindow"] == 4.0 and body["topPaths"][0]["edges"][0]["localScore"] > 0
    export.write_documents(made.unionByName(made), str(tmp_path / "out"))
    back = export.read_documents(spark, str(tmp_path / "out")).collect()
    assert [(r.input, r.output, r.parameters.beam) for r in back] == [("kyouha", "今日は", 16)] * 2


def test_reports_hold_the_whole_session(spark):
    texts = spark.createDataFrame([("kyouhacommitsimasita",)], "text string")
    at = F.lit("2026-01-01").cast("timestamp")
    lattice_doc, phonetic_doc = (json.loads(r(texts, at=at).first()["json"]) for r in (reports.lattice_report, reports.phonetic_report))
    consensus_doc = json.loads(reports.consensus_report(texts, lexicon(spark), at=at).first()["json"])
    for doc in (lattice_doc, phonetic_doc, consensus_doc):
        assert doc["generatedAtUtc"].startswith("2026-01-01T") and len(doc["frames"]) == 20 and doc["input"] == "kyouhacommitsimasita"
    for doc, active in ((lattice_doc, "activeBestSegments"), (phonetic_doc, "activeSegments")):
        assert "".join(x["output"] for x in doc["committedSegments"] + doc[active]) == doc["output"] == "今日はcommitしました"
    assert "".join(x["converted"] for x in consensus_doc["finalSegments"]) == consensus_doc["converted"]
    assert len(consensus_doc["finalBoundaries"]) == 20


def test_lattice_edges_agree_with_the_decoder(spark):
    from mojiweave.sources.tables import profile_words

    texts = spark.createDataFrame([(t,) for t in ("kyouhacommit", "repoha", "a.bc", "")], "text string")
    lexical = lattice.lexical_edges(texts, lexicon(spark), profile_words(spark)).select("text", "start", "end", "output", "kind", F.round("local_score", 9))
    spans = lattice.phonetic_edges(texts, profile_words(spark)).select("text", "start", "end", "output", "kind", F.round("local_score", 9))
    got = {tuple(r) for r in lexical.unionByName(spans).collect()}
    edges = {(t, e.start, e.end, e.output, e.kind, round(e.score, 9)) for t in ("kyouhacommit", "repoha", "a.bc") for e in L.candidate_edges(t, LatticeParameters())}
    assert got == {e for e in edges if e[4] in ("JapaneseLexical", "EnglishLexical", "JapanesePhonetic")}


def test_all_edges_agree_with_the_decoder(spark):
    from mojiweave.sources.tables import profile_words

    texts = sorted({t for t in fuzz(120)} | {"node.jswotukau", "c++wo", "c#wo", "a.b.c", "v2.0", "1.2", "averyverylongname12.js", "x+y+", ""})
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = lattice.candidate_edges(df, lexicon(spark), profile_words(spark)).select("text", "start", "end", "output", "language", "kind", F.round("local_score", 9), "evidence").collect()
    expected = {(t, e.start, e.end, e.output, e.language, e.kind, round(e.score, 9), e.evidence) for t in texts for e in L.candidate_edges(t, LatticeParameters())}
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected


def test_spans_are_read_from_their_start_and_priced_without_a_join_on_them(spark):
    """What starts at a place is cut into tokens once: its beginnings are those that convert by themselves; no span is in a shuffle."""
    import re

    from mojiweave.functions import phonetic
    from mojiweave.sources.tables import profile_words

    texts = ["kyouhacommit", "nn", "nna", "nnn", "nyk", "nya", "kka", "kkk", "anna", "a.bcn+kan", "n", "konnnichiha", "xtu", "abcdefghijklmnopqrstuvwxyz", "ka" * 20, "", "...", "sshanmmann"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {tuple(r) for r in lattice.phonetic_spans(df).select("text", "start", "n", "output").collect()}
    cut = spark.createDataFrame([(t, i, n, t[i : i + n]) for t in texts for i in range(len(t)) for n in range(1, min(24, len(t) - i) + 1) if re.fullmatch("[a-z]+", t[i : i + n])], "text string, start int, n int, raw string")
    assert got == {(r.text, r.start, r.n, r.k) for r in cut.withColumn("k", phonetic.kana(F.col("raw"))).collect() if r.k is not None}
    plan = lattice.phonetic_edges(df, profile_words(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "(raw#" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_latin_spans_are_priced_without_a_join_on_them(spark):
    """Each span comes once, with the letters of both sides; only grams and one row of entries are joined."""
    from mojiweave.sources.tables import profile_words

    texts = ["node.jswotukau", "c++wo", "c#", "a1.2b.c3", "1.2", "v2.0", "x+y+", "x+++", "a.b.c", "abcdefghijklmnop.qrstuvwxyzabcdef", "9a8b7.6c5d4no", "a-", "-a", ".", "", "a_b@c/d"]
    df = spark.createDataFrame([(t,) for t in [*texts, *texts]], "text string")
    edges = lattice.structural_edges(df, lexicon(spark), profile_words(spark))
    got = sorted(tuple(r) for r in edges.select("text", "start", "end", "raw", "output", F.round("local_score", 9)).collect())
    assert got == sorted((t, e.start, e.end, e.raw, e.output, round(e.score, 9)) for t in texts for e in L.candidate_edges(t, LatticeParameters()) if e.kind == "LatinStructural")
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Join" in x and "gram#" not in x and "Join Cross" not in x] == []


def test_what_a_part_of_edges_holds_does_not_grow_with_the_texts(spark, monkeypatch):
    from mojiweave.operators import dictionary
    from mojiweave.sources.tables import profile_words

    texts = [f"kyouha{'abcdefghij'[i % 10]}{i}.js" for i in range(240)]
    monkeypatch.setattr(dictionary, "PART", 64, raising=False)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    held = lattice.candidate_edges(df, lexicon(spark), profile_words(spark)).select(F.spark_partition_id().alias("part"), "text").distinct().groupBy("part").agg(F.count("text").alias("n")).collect()
    assert sum(r.n for r in held) == len(texts) and max(r.n for r in held) <= 24
