"""The study's seeded split is that of the standard generator over the declared list."""

import random

import pytest

from mojiweave.operators import oov
from mojiweave.sources.fixed import DECLARED, ENTRIES, OOV_WORDS, PHONETIC_WORDS


@pytest.mark.parametrize("seed", [20261010, 20261011, 20261012, 20261013, 20261014])
def test_japanese_split(spark, seed):
    want = list(DECLARED)
    random.Random(seed).shuffle(want)
    assert sorted(want) == sorted({e.raw for e in ENTRIES if e.language == "Japanese"})
    assert [r.word for r in oov.japanese_places(spark, seed).orderBy("place").collect()] == want
    parts = oov.split(spark.createDataFrame([("english",)], "word string"), seed)
    got = {k: {r.word for r in parts.filter(f"language = 'Japanese' and part = '{k}'").collect()} for k in ("train", "dev", "test")}
    assert got == {"train": set(want[:55]), "dev": set(want[55:70]), "test": set(want[70:])}
    negative = [r.word for r in oov.negatives(parts, seed).orderBy("ord").collect()]
    assert negative[:15] == want[70:] and len(negative) == 34


def harness(english, japanese):
    return "\n".join(
        [
            'var other = new[] { "notaword" };',
            "private static readonly EvalToken[] EnOov = new[]",
            "{",
            *(f'    "{w}",' for w in english),
            "}.Select(w => new EvalToken(w, w)).ToArray();",
            "private static readonly EvalToken[] JaPhoneticOnly =",
            "[",
            *(f'    new("{w}", "x"),' for w in japanese),
            "];",
            'var more = new("after", "x");',
        ]
    )


def test_words_of_a_harness_file(spark, tmp_path):
    path = tmp_path / "Corpus.txt"
    path.write_text(harness(OOV_WORDS, PHONETIC_WORDS), encoding="utf-8")
    own = [tuple(r) for r in oov.study_words(spark, str(path)).collect()]
    assert sorted(own) == sorted(tuple(r) for r in oov.study_words(spark).collect())
    path.write_text(harness(OOV_WORDS[1:], PHONETIC_WORDS), encoding="utf-8")
    with pytest.raises(ValueError):
        oov.study_words(spark, str(path))
    path.write_text("nothing of it", encoding="utf-8")
    with pytest.raises(ValueError):
        oov.study_words(spark, str(path))


def test_the_study_reads_documents_once(spark):
    """Split, models and threshold are written tables: no view of the study reads documents or counts grams again."""
    from mojiweave.plans import queries

    held = queries.study(spark, "/root/testdata/sf0.001")
    for name in ("oov_lists", "oov_confusion"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001", held)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan
    assert all("Aggregate" not in d._jdf.queryExecution().optimizedPlan().toString() for d in held)
