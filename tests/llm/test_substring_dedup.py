import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from mojiweave.llm import common
from mojiweave.llm import substring_dedup as S


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.!? \n\t", max_size=80))
def test_sentences_cover_the_text(text):
    starts, words = S.sentences(text)
    assert "".join(text[a:b] for a, b in zip(starts, starts[1:])) == (text if words else "")
    assert [w for s in words for w in s] == text.lower().split()
    assert all(words)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def own_sentences(text):
    """Words and where they end, word by word, by the rule as it is stated."""
    starts, words, held = [], [], []
    for m in re.finditer(r"\S+\s*", text):
        if not held:
            starts.append(m.start() if words else 0)
        word = m.group().rstrip()
        held.append(word.lower())
        after = m.group()[len(word) :]
        if "\n" in after or (after and word[-1] in ".!?") or zlib.crc32(word.lower().encode()) % 12 == 0:
            words.append(held)
            held = []
    if held:
        words.append(held)
    return [*starts, len(text)], words


def brute(texts):
    """Which sentences go, from all spans of all texts in order."""
    seen, gone = {}, [set() for _ in texts]
    for k, t in enumerate(texts):
        words = own_sentences(t or "")[1]
        n = len(words)

        def enough(i, j):
            return j - i >= S.MIN_SENTENCES and sum(map(len, words[i:j])) >= S.MIN_WORDS

        spans = {(i, j) for i in range(n) for j in range(i + 1, n + 1) if enough(i, j) and not (enough(i, j - 1) and enough(i + 1, j))}
        for i, j in sorted(spans) or ([(0, n)] if n else []):
            key = tuple(" ".join(w) for w in words[i:j])
            if key in seen:
                gone[k].update(range(i, j))
            seen.setdefault(key, (k, i))
    return gone


def test_against_brute_force(docs_of):
    rng = random.Random(4)
    shared = [" ".join(sentence(rng, rng.randrange(4, 14)) for _ in range(8)) for _ in range(4)]
    texts = []
    for _ in range(50):
        parts = [sentence(rng, rng.randrange(1, 20)) for _ in range(rng.randrange(6))]
        for p in rng.sample(shared, rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), p)
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += [None, "", "no end at all " * 30, "no end at all " * 30, "Two words. And more.", "Two words. And more.", "One.", "Two words. And more. Yes.", "One."]
    got = {r.doc_id: r for r in S.remove_repeats(docs_of(texts)).collect()}
    for k, (t, gone) in enumerate(zip(texts, brute(texts), strict=True)):
        starts, words = own_sentences(t or "")
        kept = "".join(t[starts[i] : starts[i + 1]] for i in range(len(words)) if i not in gone) if gone else t
        assert (got[k].text, got[k].n_removed, got[k].n_sentences) == (kept, len(gone), len(words))
    assert sum(r.n_removed > 0 for r in got.values()) > 10


def test_passage_of_fifty_words_is_found_amid_other_text(docs_of):
    rng = random.Random(6)
    passage = " ".join(sentence(rng, 13) for _ in range(4))
    texts = [f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}" for _ in range(6)] + [sentence(rng, 60) for _ in range(6)]
    rows = {r.doc_id: r for r in S.remove_repeats(docs_of(texts)).collect()}
    assert passage in rows[0].text and all(passage not in rows[i].text for i in range(1, 6))
    assert [rows[i].n_removed for i in (0, *range(6, 12))] == [0] * 7


def test_a_passage_pasted_into_run_on_text_is_cut_as_in_its_first_place(docs_of):
    rng = random.Random(16)
    texts, inner = [], []
    for _ in range(60):
        passage = " ".join(sentence(rng, 28 + k) for k in range(2))
        texts += [passage, " ".join([sentence(rng, 20)[:-1], passage[:-1], sentence(rng, 20)])]
        inner.append(len(passage))
    got = {r.doc_id: r for r in S.remove_repeats(docs_of(texts)).collect()}
    lost = [len(texts[k]) - len(got[k].text) for k in range(1, len(texts), 2)]
    assert all(got[k].n_removed == 0 for k in range(0, len(texts), 2))
    # what is before the first cut inside a passage and after the last one cannot be told from what is around it
    assert sum(x > 0 for x in lost) >= 50 and sum(x > n // 2 for x, n in zip(lost, inner, strict=True)) >= 38
    assert all(x <= n for x, n in zip(lost, inner, strict=True))


def test_odd_rows(odd_docs, docs_of):
    out = S.remove_repeats(odd_docs)
    rows = out.collect()
    assert len(rows) == 8 and out.columns == [*odd_docs.columns, "n_sentences", "n_removed"]
    assert {r.text for r in rows if r.doc_id == 2} == {None}
    assert S.remove_repeats(docs_of([])).count() == 0


def test_short_equal_texts_and_a_very_common_span(docs_of, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rng = random.Random(8)
    passage = " ".join(sentence(rng, 9) for _ in range(3))
    own = [sentence(rng, 12) for _ in range(30)]
    texts = [f"{x}\n{passage}" for x in own] + ["Short text. Said twice."] * 2
    got = {r.doc_id: r for r in S.remove_repeats(docs_of(texts)).collect()}
    assert got[0].n_removed == 0 and all(got[k].text == f"{own[k]}\n" for k in range(1, 30))
    assert got[30].n_removed == 0 and got[31].n_removed >= 2 and got[31].text == ""


def test_the_last_sentence_of_a_passage_goes_too(docs_of):
    rng = random.Random(3)
    passage = " ".join(sentence(rng, n) for n in (9, 9, 9, 5))
    texts = [passage + " " + sentence(rng, 20), sentence(rng, 20) + " " + passage + " " + sentence(rng, 18)]
    got = {r.doc_id: r for r in S.remove_repeats(docs_of(texts)).collect()}
    assert got[0].n_removed == 0 and passage not in got[1].text and passage.split()[-1] not in got[1].text.split()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = S.op8_substring_dedup(spark, sf)
    assert {f.name: f.dataType.simpleString() for f in out.schema} == {"doc_id": "bigint", "n_sentences": "bigint", "n_removed": "bigint", "has_repeats": "boolean", "text": "string"}
    docs = sorted(((d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=lambda d: d[0])
    got = {r.doc_id: r for r in out.collect()}
    for (i, _), gone in zip(docs, brute([t for _, t in docs]), strict=True):
        assert got[i].n_removed == len(gone)


def test_common_spans_are_marked_where_they_are_picked(spark, monkeypatch):
    """Spans that very many documents share are dealt over parts by a mark that their rows already hold; no row is joined with a filter for it."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    shared = " ".join(f"word{i}" for i in range(20)) + ". " + " ".join(f"more{i}" for i in range(20)) + ". "
    docs = spark.createDataFrame([(i, shared + f"tail {i} here") for i in range(30)] + [(99, "a text of its own")], "doc_id long, text string")
    with common.scratch_paths():
        gone = S.covered(common.keyed(docs), S.MIN_SENTENCES, S.MIN_WORDS)
        assert "_chunk" not in gone._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r._doc for r in gone.collect()) == list(range(1, 30))
