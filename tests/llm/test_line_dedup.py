import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mojiweave.llm import common
from mojiweave.llm import line_dedup as D


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def brute(docs, least=D.MIN_CHARS):
    """docs: (key, text) in order -> key -> remaining text."""
    first, lines = {}, []
    for k, (_, t) in enumerate(docs):
        for no, x in enumerate((t or "").split("\n")):
            n = D.normal(x)
            if len(n) >= least:
                first.setdefault(n, (k, no))
                lines.append((k, no, n))
    near = {n for n in first if any(distance_one(n, m) and first[m] < first[n] for m in first)}
    gone = {(k, no) for k, no, n in lines if n in near or first[n] != (k, no)}
    return [None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (k, no) not in gone) for k, (_, t) in enumerate(docs)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab", min_size=D.MIN_CHARS, max_size=90), st.integers(0, 10**6), st.sampled_from("sid"), st.sampled_from("abc"))
def test_one_edit_always_shares_a_coarse_and_a_middle_key(a, at, how, c):
    at %= len(a) + (how == "i")
    b = a[:at] + {"s": c + a[at + 1 :], "i": c + a[at:], "d": a[at + 1 :]}[how]
    if a == b or len(b) < D.MIN_CHARS:
        return

    def coarse(x):
        return {(seed, x[:p], x[len(x) - s :]): k for k, (seed, p, s) in enumerate(D.coarse_spans(len(x)))}

    def middle(x, k):
        return {(seed, x[:p], x[len(x) - s :]) for seed, p, s in D.part_spans(len(x), k)}

    ka, kb = coarse(a), coarse(b)
    shared = set(ka) & set(kb)
    assert shared
    found = False
    for key in shared:
        for pa in D.part_spans(len(a), ka[key]):
            for pb in D.part_spans(len(b), kb[key]):
                if (pa[0], a[: pa[1]], a[len(a) - pa[2] :]) == (pb[0], b[: pb[1]], b[len(b) - pb[2] :]):
                    va = {(a[:p] + a[p + 1 :], p) for p in range(pa[1], len(a) - pa[2])}
                    vb = {(b[:p] + b[p + 1 :], p) for p in range(pb[1], len(b) - pb[2])}
                    found |= bool(va & vb) or b in {v for v, _ in va} or a in {v for v, _ in vb}
    assert found


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(docs_of, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(5, 70))).strip() for _ in range(25)]

    def variant():
        x = rng.choice(base)
        for _ in range(rng.randrange(3)):
            p = rng.randrange(len(x) + 1)
            x = rng.choice([x[:p] + "e" + x[p:], x[:p] + x[p + 1 :], x[:p] + "f" + x[p + 1 :]])
        return x

    texts = ["\n".join(variant() for _ in range(rng.randrange(6))) for _ in range(60)] + [None, ""]
    got = {r.doc_id: r.text for r in D.dedup_lines(docs_of(texts), exact_chars=D.MIN_CHARS).collect()}
    assert [got[i] for i in range(len(texts))] == brute(list(enumerate(texts)))


def test_odd_rows(odd_docs, docs_of):
    out = D.dedup_lines(odd_docs)
    rows = out.collect()
    assert len(rows) == 8 and out.columns == [*odd_docs.columns, "n_lines", "n_removed", "n_removed_chars"]
    assert [r.n_removed for r in rows if r.doc_id == 1] == [0, 0]  # a repeated row is the same document
    assert [r.text for r in rows if r.doc_id == 2] == [None]
    assert next(r for r in rows if r.doc_id == 6).n_removed == 2
    assert D.dedup_lines(docs_of([])).count() == 0


def test_emptied_documents_go(docs_of):
    line = "a line of more than twenty characters"
    own = "and one of its own here, longer than that line is"
    docs = docs_of([line, line, f"{line}\n{own}", "", None, f"{line}\na bit of its own"])
    out = D.drop_repeated_lines(docs).collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in out} == {0: (line, len(line)), 2: (own, len(own)), 3: ("", 0), 4: (None, None)}
    out = D.drop_repeated_lines(docs, least_left=(0, 1)).collect()
    assert {r.doc_id: r.text for r in out} == {0: line, 2: own, 3: "", 4: None, 5: "a bit of its own"}


def brute_exact(texts):
    """The lines left if those of MIN_CHARS characters or more go by brute() and shorter ones with a word as exact repeats."""
    seen, out = set(), []
    for t, left in zip(texts, brute(list(enumerate(texts))), strict=True):
        lines = []
        for x in (left or "").split("\n"):
            n = D.normal(x)
            if len(n) >= D.MIN_CHARS or not n or n not in seen:
                lines.append(x)
            seen.add(n)
        out.append(None if t is None else "\n".join(lines))
    return out


def stays(text, left):
    """Whether a document stays of which this is left: some word, and half of its characters."""
    return left == text or 0 < len("".join(text.split())) <= 2 * len("".join(left.split()))


def test_short_lines_go_as_exact_repeats(spark, docs_of, tmp_path):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 30))).strip() for _ in range(40)] + ["", "un.", " \t", "İ" * 19, "İ" * 18 + "j"]
    texts = ["\n".join(rng.choice((x, x.upper(), f" {x} ")) for x in rng.choices(base, k=rng.randrange(6))) for _ in range(80)] + [None, "", "Un.", "un!"]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in D.op5_line_dedup(spark, str(tmp_path)).collect()}
    want = brute_exact(texts)
    assert [got[i].text for i in range(len(texts))] == want
    assert got[len(texts) - 2].n_removed == 1 and got[len(texts) - 1].n_removed == 0
    kept = {r.doc_id: r.text for r in D.drop_repeated_lines(docs_of(texts)).collect()}
    assert kept == {i: want[i] for i in range(len(texts)) if stays(texts[i], want[i])}


def test_copy_with_short_lines_goes(docs_of):
    text = "a line of more than twenty characters\nles.\n\u3000\nun."
    out = D.drop_repeated_lines(docs_of([text, text, "un.\nles.", "les.\nits own"])).collect()
    assert {r.doc_id: r.text for r in out} == {0: text, 3: "its own"}


def test_hashes_are_those_of_the_cut_lines():
    rng = random.Random(9)
    lines = ["".join(rng.choice("ab\u3042\U0001f600 ") for _ in range(rng.randrange(1, 40))) for _ in range(50)] + ["", "a" * 3000]
    h = D.Hashes(lines)
    for i, x in enumerate(lines):
        for p in range(len(x)):
            cut = x[:p] + x[p + 1 :]
            assert h.without(np.asarray([i]), np.asarray([p]))[0] == D.Hashes([cut]).whole(np.asarray([0]))[0]
    whole = h.whole(np.arange(len(lines)))
    assert len(set(whole.tolist())) == len(set(lines))


def test_two_long_lines_in_linear_time(docs_of):
    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh ") for _ in range(900_000)).strip()
    texts = [line, line[:500_000] + "Z" + line[500_001:], line[:77] + line[78:], line[:-1] + "yy", line[::-1]]
    start = time.monotonic()
    got = {r.doc_id: r.n_removed for r in D.dedup_lines(docs_of(texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0} and time.monotonic() - start < 60


def test_a_very_common_line(docs_of, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    texts = [f"own line number {k} of this text {k * k}\nthe line that all texts have in common\nok" for k in range(40)]
    got = {r.doc_id: r.text for r in D.dedup_lines(docs_of(texts)).collect()}
    assert got[0] == texts[0] and all(got[k] == texts[k].split("\n")[0] for k in range(1, 40))


def test_string_ids(docs_of):
    from pyspark.sql import functions as F

    docs = docs_of(["the same line of text in both\nx1", "the same line of text in both\nx2"]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id: r.text for r in D.dedup_lines(docs).collect()} == {"d0": "the same line of text in both\nx1", "d1": "x2"}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = D.op5_line_dedup(spark, sf)
    assert {f.name: f.dataType.simpleString() for f in out.schema} == {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "has_repeats": "boolean", "text": "string"}
    docs = sorted(((d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=lambda d: d[0])
    got = {r.doc_id: r for r in out.collect()}
    for (i, t), left in zip(docs, brute_exact([t for _, t in docs]), strict=True):
        assert got[i].text == left and got[i].n_lines == (0 if t is None else t.count("\n") + 1)
