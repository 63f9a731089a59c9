"""Column functions against the plain Python reading, and edge cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mojiweave.functions import phonetic, syntax
from mojiweave.operators import dictionary, oov, profile
from mojiweave.plans import reading as R
from mojiweave.sources.fixed import ENTRIES, KANA, OOV_WORDS
from mojiweave.sources.tables import lexicon, profile_words
from tests.test_sessions import fuzz


@pytest.mark.parametrize("text,expected", [("seido", "せいど"), ("method", "め{t?}ほ{d…}"), ("commit", "{c?}おっみ{t…}"), ("", "")])
def test_preview(text, expected):
    assert R.preview(text) == expected


@pytest.mark.parametrize("word,expected", [("commit", 0.7333), ("github", 0.7333), ("network", 0.6357), ("kernel", 0.6833), ("cache", 0.62), ("method", 0.7333), ("issue", 1.0), ("debug", 0.87), ("repo", 1.0)])
def test_readability(word, expected):
    assert round(R.readability(R.units(word), 0, len(word)), 4) == expected


def test_native_units_are_the_plain_ones(spark):
    texts = fuzz(300) + list(KANA) + [e.raw for e in ENTRIES] + ["konna", "ny", "nny", "tt", "xx", "kanji", "あb", ""]
    df = spark.createDataFrame([(t,) for t in sorted(set(texts))], "text string").withColumn("u", phonetic.units(F.col("text")))
    c = phonetic.coverage(F.col("text"), F.col("u"))
    n = F.length("text")
    for r in df.select("text", "u", phonetic.kana(F.col("text")).alias("k"), c["unresolved_ratio"].alias("x"), phonetic.readability(F.col("u"), F.lit(0), n).alias("r"), phonetic.preview(F.col("u")).alias("p")).collect():
        assert [(u.start, u.end, u.preview, u.kind, u.confidence) for u in r.u] == R.units(r.text), r.text
        letters = bool(r.text) and all(x in R.LETTERS for x in r.text)
        assert r.k == (R.to_kana(r.text) if letters else None)
        assert abs(r.x - R.unresolved(r.text)) < 1e-12 and abs(r.r - R.readability(R.units(r.text), 0, len(r.text))) < 1e-12


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aiueonkstymhcjx", max_size=12))
def test_kana_is_all_or_nothing(text):
    whole = all(k == "Kana" for *_, k, _ in R.units(text)) and bool(text)
    assert (R.to_kana(text) is not None) == whole


def test_syntax(spark):
    df = spark.createDataFrame([("A=b&C d",), ("ÉÜa",), ("ok.",), (None,), ("",)], "t string")
    rows = df.select("t", syntax.is_allowed(F.col("t")).alias("a"), syntax.lenient(F.col("t")).alias("l"), syntax.normalize(F.col("t")).alias("n")).collect()
    assert [(r.a, r.l, r.n) for r in rows] == [(False, "abc d", "a=b&c d"), (False, "a", "ÉÜa"), (True, "ok.", "ok."), (None, None, None), (True, "", "")]
    with pytest.raises(Exception, match="not allowed"):
        df.select(syntax.strict(F.col("t"))).collect()


def test_profile_scores_are_the_plain_ones(spark):
    words = ["kyou", "commit", "x", "", "zzzz"]
    got = profile.scores(spark.createDataFrame([(w,) for w in words], "word string"), profile_words(spark)).collect()
    for r in got:
        ja, en = R.profile_scores(r.word)
        assert abs(r.japanese - ja) < 1e-9 and abs(r.english - en) < 1e-9


def test_boundary_support_ends(spark):
    got = {r.position: r.support for r in dictionary.boundary_support(spark.createDataFrame([("kyouha",), ("",)], "text string"), lexicon(spark)).collect()}
    assert got[0] == 0 and got[6] == 0 and got[4] > 0.6 and got[2] < got[4]


def test_boundary_support_of_every_place(spark):
    words = ["kyouha", "kyouhacommitsi", "a", "wa", "node", "commi", "simasit", "hahaha", "zzzz", "nihongowotuka"]
    texts, entries = spark.createDataFrame([(w,) for w in words], "text string"), lexicon(spark)
    places = dictionary.boundary_support(texts, entries)
    sure = {r.raw: max(0.0, min(1.0, (r.weight - 3.5) / 3.5)) for r in entries.collect()}
    for r in places.collect():
        w, at = r.text, r.position
        left = max((s for e, s in sure.items() if w[:at].endswith(e)), default=0.0)
        right = max([s for e, s in sure.items() if w[at:].startswith(e)] + [0.75 * s for e, s in sure.items() if 0 < at < len(w) and e.startswith(w[at:]) and len(e) > len(w) - at], default=0.0)
        want = 0.0 if at in (0, len(w)) else (left * right) ** 0.5 if left > 0 and right > 0 else 0.35 * max(left, right)
        assert abs(r.support - want) < 1e-12, r
    assert places.count() == sum(len(w) + 1 for w in words)


def test_boundary_query_has_a_row_for_each_place(spark):
    from mojiweave.plans.queries import QUERIES
    from mojiweave.plans.sql import ORACLES

    assert QUERIES["boundary_lexical_support"](spark, "/root/testdata/sf0.001").columns == ["text", "position", "support"]
    assert "string_agg(position" not in ORACLES["boundary_lexical_support"]


def test_study(spark):
    words = spark.createDataFrame([(w,) for w in OOV_WORDS], "word string")
    japanese, english = oov.gram_counts(oov.japanese_words(spark)), oov.gram_counts(words)
    d = {r.word: r.difference for r in oov.differences(spark.createDataFrame([("kyouha",), ("mention",)], "word string"), english, japanese).collect()}
    assert d["mention"] > 0 > d["kyouha"]
    assert oov.glued(spark.createDataFrame([(w, i) for i, w in enumerate(["kuru", "iku", "matsu"])], "word string, ord int")).count() > 50
    dev = spark.createDataFrame([("English", 1.0), ("English", -0.5), ("Japanese", -1.0)], "language string, difference double")
    assert tuple(oov.choose_threshold(dev).first()) == (1.0, -1.0)
    p = oov.discordance(spark.createDataFrame([(True, False)] * 29 + [(False, True)] * 2, "first boolean, second boolean")).first()
    assert (p.first_only, p.second_only) == (29, 2) and abs(p.p_two_sided - 4.63e-7) < 1e-8
