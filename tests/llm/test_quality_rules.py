import random
import re
from collections import Counter

import numpy as np
import pytest

from mojiweave.llm import quality_rules as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_counts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab #\n\t\x0b\x85é |") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "a a a a", "a b c\na b c"]
    for t in texts:
        c = dict(zip(Q.COUNTS, Q.text_counts(t), strict=True))
        assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == brute(t), t


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) + ("." if k % 9 == 8 else "") for k in range(n))


def test_clean_stays_and_junk_goes(docs_of):
    rng = random.Random(5)
    clean = [prose(rng, 150) for _ in range(80)]
    junk = [" ".join(f"{w}###" for w in prose(rng, 120).split()) for _ in range(8)] + [" | ".join(prose(rng, 120).split()) for _ in range(8)]
    short, loop = ["tiny text"], ["same old words here " * 40]
    docs = docs_of(clean + junk + short + loop)
    rows = {r.doc_id: r for r in Q.judge(docs).collect()}
    assert all(rows[i].kept for i in range(80)) and not any(rows[i].kept for i in range(80, len(rows)))
    assert rows[96].base_failed and rows[97].base_failed
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(80))


def test_odd_rows(odd_docs, docs_of):
    rows = Q.judge(odd_docs).collect()
    assert len(rows) == 8 and {r.n_words for r in rows if r.doc_id in (2, 3, 4)} == {0}
    kept = Q.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Q.judge(docs_of([])).count() == 0 and Q.keep_good(docs_of([])).count() == 0


def test_em_trusts_a_rule_by_what_others_say():
    patterns = [((1, 1, 1), 900), ((-1, 1, 1), 3), ((-1, -1, 1), 50), ((-1, -1, -1), 30), ((0, 0, 0), 5)]
    p_good, p_bad, prior, q = Q.fit_em(patterns, 3)
    assert q[0] > 0.95 and q[2] < 0.1 and q[3] < 0.1 and 0.8 < prior < 0.99


def simulated(noise=None, n=100_000):
    rng = np.random.default_rng(1)
    truth = rng.random(n) < 0.95
    known = [(0.99, 0.10, 0.1), (0.98, 0.20, 0.2), (0.97, 0.15, 0.1), (0.995, 0.30, 0.3)]
    votes = [np.where(rng.random(n) < silent, 0, np.where(rng.random(n) < np.where(truth, good, bad), 1, -1)) for good, bad, silent in known]
    if noise is not None:
        votes.append(np.where(rng.random(n) < noise, -1, 1))
    rows = list(zip(*(v.tolist() for v in votes), strict=True))
    patterns = sorted(Counter(rows).items())
    p_good, p_bad, prior, q = Q.fit_em(patterns, len(votes))
    kept = dict(zip((p for p, _ in patterns), q >= 0.5, strict=True))
    return truth, known, p_good, p_bad, prior, np.asarray([kept[r] for r in rows])


def test_em_recovers_known_accuracies():
    truth, known, p_good, p_bad, prior, kept = simulated()
    assert np.abs(p_good - [k[0] for k in known]).max() < 0.02 and np.abs(p_bad - [k[1] for k in known]).max() < 0.02
    assert abs(prior - truth.mean()) < 0.01 and (kept == truth).mean() > 0.99


@pytest.mark.parametrize("noise", [0.1, 0.2, 0.4])
def test_a_noisy_rule_changes_nothing(noise):
    *_, without = simulated()
    _, _, p_good, p_bad, _, kept = simulated(noise)
    assert abs(p_good[-1] - (1 - noise)) < 0.02 and abs(p_bad[-1] - (1 - noise)) < 0.02
    assert (kept != without).mean() < 0.01


def test_a_posterior_at_the_threshold_keeps(docs_of):
    rows = Q.judge(docs_of([prose(random.Random(1), 90)] * 3))
    p = rows.first().p_good
    assert {r.kept for r in Q.judge(docs_of([prose(random.Random(1), 90)] * 3), threshold=p).collect()} == {True}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = Q.op2_quality_rules(spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema][:8] == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", "boolean"), ("kept", "boolean")]
    rows = {r.doc_id: r for r in out.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(rows) == {d.doc_id for d in docs}
    for d in docs:
        r, want = rows[d.doc_id], brute(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(rows[i].kept, y) for i, y in labels.items() if i in rows and y is not None and not rows[i].base_failed]
    assert sum(k == bool(y) for k, y in judged) > 0.95 * len(judged)
    assert {r.doc_id for r in Q.keep_good(spark.read.parquet(f"{sf}/documents.parquet")).collect()} == {i for i, r in rows.items() if r.kept}
