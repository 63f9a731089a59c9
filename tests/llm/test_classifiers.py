import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from mojiweave.llm import quality_knn, toxicity
from mojiweave.llm.labelled import labelled_sample, remainder


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    texts, toxic, good = [], [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(40, 120))]
        y, q = i % 5 == 0, i % 7 != 0
        if y:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["grumble", "snarl", "zorgwick" + rng.choice("abc")])
        if not q:
            words = [f"{w.upper()}!!" for w in words]
        texts.append(" ".join(words))
        toxic.append(int(y))
        good.append(int(q))
    return texts, toxic, good


def labels_of(spark, values, name):
    return spark.createDataFrame(list(enumerate(values)), f"doc_id long, {name} int")


def test_toxicity_on_held_out_rows(spark, docs_of):
    texts, toxic, _ = corpus()
    docs = docs_of(texts)
    held = remainder(F.col("doc_id"), 4) == 2
    model = toxicity.fit(labelled_sample(docs, labels_of(spark, toxic, "toxic"), "toxic", ~held, 1000))
    rows = toxicity.score_documents(docs, model).filter(held).collect()
    assert len(rows) > 60 and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score >= 0.3) == toxic[r.doc_id] for r in rows)
    assert "snarl" in model.lexicon.words and "zorg" in model.lexicon.prefixes


def test_quality_on_held_out_rows(spark, docs_of):
    texts, _, good = corpus()
    docs = docs_of(texts)
    held = remainder(F.col("doc_id"), 5) == 0
    voters = quality_knn.fit(docs, labelled_sample(docs, labels_of(spark, good, "quality"), "quality", ~held, 1000))
    rows = quality_knn.score_documents(docs, voters).filter(held).collect()
    assert len(rows) > 60 and all((r.score >= 0.3) == good[r.doc_id] for r in rows)


def test_votes_are_those_of_all_cosines():
    rng = np.random.default_rng(2)
    space = np.linalg.qr(rng.standard_normal((quality_knn.PLACES, 8)))[0].astype(np.float32)
    y = rng.integers(0, 2, 50).astype(float)
    rows = [(np.sort(rng.choice(quality_knn.PLACES, 30, replace=False)), rng.random(30).astype(np.float32)) for _ in range(70)]
    v = quality_knn.Voters(None, space, None, y, 0.5)
    v.vectors = v.project(rows[:50])
    got, q = v.vote(rows[50:]), v.project(rows[50:])
    for k in range(20):
        cos = v.vectors @ q[k]
        top = np.argsort(-cos)[: quality_knn.NEIGHBOURS]
        w = np.maximum(cos[top], 0)
        assert abs(got[k] - (w * y[top]).sum() / w.sum()) < 1e-5


def test_isotonic_is_monotone_and_least_squares():
    rng = np.random.default_rng(3)
    x = rng.standard_normal(300).round(1)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x))).astype(float)
    knots, values = toxicity.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    assert abs(np.interp(x, knots, values).mean() - y.mean()) < 0.02


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = toxicity.Boosted().fit(x, y).margin(x)
    assert ((m > 0) == y).mean() > 0.95


def test_odd_rows(spark, odd_docs, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    some = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (3, None, None), (5, 0, 1)], "doc_id long, toxic int, quality int")
    for labels in (none, some):
        for op, label, fit in ((toxicity, "toxic", lambda d, s: toxicity.fit(s)), (quality_knn, "quality", quality_knn.fit)):
            for docs in (odd_docs, docs_of([])):
                model = fit(docs, labelled_sample(docs, labels, label, F.lit(True), 100))
                rows = op.score_documents(docs, model).collect()
                assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_sample_is_bounded_and_repeatable(spark, docs_of):
    docs, labels = docs_of([f"text {i}" for i in range(50)]), labels_of(spark, [i % 2 for i in range(50)], "toxic")
    a, b = (sorted(map(tuple, labelled_sample(docs, labels.repartition(k), "toxic", remainder(F.col("doc_id"), 4) != 2, 12).collect())) for k in (1, 5))
    assert a == b and len(a) == 12


def test_space_is_nearly_that_of_a_plain_decomposition(spark, docs_of):
    texts, _, good = corpus(150)
    docs = docs_of(texts)
    voters = quality_knn.fit(docs, labelled_sample(docs, labels_of(spark, good, "quality"), "quality", F.lit(True), 1000))
    places = quality_knn._Places()
    dense, df = np.zeros((len(texts), quality_knn.PLACES)), np.zeros(quality_knn.PLACES)
    for t in texts:
        df[quality_knn.term_counts(t, places)[0]] += 1
    assert np.allclose(voters.idf, np.log((len(texts) + 1) / (df + 1)) + 0.1)
    for k, t in enumerate(texts):
        at, n = quality_knn.term_counts(t, places)
        dense[k, at] = quality_knn.weighted(at, n, voters.idf)
    best = (np.linalg.svd(dense, compute_uv=False)[: quality_knn.RANK] ** 2).sum()
    q = dense @ voters.space
    assert (q**2).sum() > 0.97 * best and np.allclose(voters.space.T @ voters.space, np.eye(quality_knn.RANK), atol=1e-4)
    assert np.allclose(voters.vectors, q / np.linalg.norm(q, axis=1, keepdims=True), atol=1e-4)


def test_a_tie_for_the_last_place_is_shared():
    space = np.eye(quality_knn.PLACES, 2, dtype=np.float32)
    y = np.asarray([1.0] * 10 + [0.0] * 30)
    v = quality_knn.Voters(None, space, np.tile(np.asarray([[1.0, 0.0]], np.float32), (40, 1)), y, 0.5)
    row = (np.asarray([0]), np.asarray([1.0], np.float32))
    assert v.vote([row])[0] == 0.25
    v.labels = y[::-1]
    assert v.vote([row])[0] == 0.25


def test_a_long_shape_is_hashed_whole():
    assert quality_knn._shape("a-1" * 9) == "a-0" * 9


def check_query(spark, op, label, n, least):
    sf = "/root/testdata/sf0.01"
    out = op(spark, sf)
    assert {f.name: f.dataType.simpleString() for f in out.schema} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % n == (2 if n == 4 else 0)) for i, r in rows.items())
    labels = [(r[label], rows[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r[label] is not None and rows[r.doc_id].held_out]
    assert len(labels) > 50 and sum(r.predicted == y for y, r in labels) >= least * len(labels)


def test_toxicity_query(spark):
    check_query(spark, toxicity.op6_toxicity, "toxic", 4, 0.95)


def test_quality_query(spark):
    check_query(spark, quality_knn.op7_quality_knn, "quality", 5, 0.93)


def plain_features(text, lexicon):
    """The features of a text, word by word."""
    words = toxicity._words(text)
    n = max(1, len(words))
    w = [lexicon.words.get(x.rstrip("!*'"), 0.0) for x in words]
    p = [lexicon.prefixes.get(x[: toxicity.PREFIX], 0.0) for x in words]
    you = [i for i, x in enumerate(words) if x in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in range(len(words)) if w[i] or p[i])
    odd = [x for x in words if re.search(r"[^\W\d_][0-9@$*!]+[^\W\d_]", x)]
    fixed = sum(x.translate(toxicity.LEET) in lexicon.words for x in odd)
    letters = sum(bool(re.fullmatch(r"[^\W\d_]", c)) for c in text)
    upper = sum(bool(re.fullmatch("[A-ZÀ-ÖØ-Þ]", c)) for c in text)
    marks = sum(bool(re.fullmatch(r"[^\w\s]", c)) for c in text)
    shouted = len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b", text))
    return [
        100 * sum(w) / n, sum(x > 0 for x in w), max(w, default=0), 100 * sum(p) / n, sum(x > 0 for x in p), max(p, default=0), 100 * near / n, len(you) / n, upper / max(1, letters), shouted / n,
        text.count("!") / n, marks / n, len(odd) / n, fixed, np.log1p(len(words)),
    ]


def test_features_are_those_of_a_plain_count():
    rng = random.Random(14)
    words = ["you", "DU", "snarl", "sn4rl", "snarling", "SNARL!!", "plain", "É", "gr*mble", "grumble,", "tú", "²", "1a", "_x", "a1b", ""]
    lexicon = toxicity.Lexicon({"snarl": 2.0, "grumble": 1.5, "gramble": 1.6}, {"snar": 1.9, "grum": 3.0})
    terms = toxicity.Terms(lexicon)
    for _ in range(300):
        text = rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(rng.randrange(25)))
        assert np.allclose(toxicity.features(text, terms), plain_features(text, lexicon)), text


def test_a_doc_id_on_very_many_rows_is_one_labelled_row(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "b"), (2, "b"), (3, None), (4, "d"), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (9, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    rows = sorted(map(tuple, labelled_sample(docs, labels, "toxic", F.lit(True), 100).collect()))
    assert [(d, y) for d, _, y in rows] == [(1, 1), (2, 0), (3, 1)] and [t for _, t, _ in rows][1:] == ["b", ""]
    again = labelled_sample(docs.repartition(5), labels, "toxic", F.lit(True), 100)
    assert sorted(map(tuple, again.collect())) == rows
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 2).count() == 2
