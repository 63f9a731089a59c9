import random
import re

import numpy as np
import pytest

from mojiweave.llm import common
from mojiweave.llm import near_dup as N
from mojiweave.llm.components import connected_components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def family(rng, words, n, edits):
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(999)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,block,wide", [(1, 512, 64), (2, 8, 64), (3, 8, 2)])
def test_against_brute_force(docs_of, monkeypatch, seed, block, wide):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "WIDE", wide)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        texts += family(rng, rng.randrange(1, 120), rng.randrange(1, 12), 4)
    texts += family(rng, 150, 60, 3) + [None, "", " \n", "one", "ONE", "one two", "É é", "é É"]
    rng.shuffle(texts)
    found = {r.doc_id: r for r in N.near_duplicates(docs_of(texts)).collect()}
    components, sizes = brute(texts)
    assert [found[i].component_id for i in range(len(texts))] == components
    assert [found[i].n_shingles for i in range(len(texts))] == sizes
    kept = {r.doc_id for r in N.drop_near_duplicates(docs_of(texts)).collect()}
    assert kept == {i for i, c in enumerate(components) if i == c}


def test_a_template_that_all_texts_share(docs_of, monkeypatch):
    """Texts of one template whose own words differ share buckets but are not linked, save those that are alike."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "WIDE", 2)
    rng = random.Random(13)
    template = [f"t{k}" for k in range(90)]
    texts = [" ".join([*template, *(f"w{rng.randrange(10**6)}" for _ in range(40))]) for _ in range(120)]
    texts += [x + " more" for x in texts[:30]]
    found = {r.doc_id: r.component_id for r in N.near_duplicates(docs_of(texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)[0]


@pytest.mark.parametrize("block,wide", [(512, 64), (8, 0)])
def test_rows_that_repeat_a_doc_id(spark, monkeypatch, block, wide):
    """All rows of a doc_id have the component of all its links."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "WIDE", wide)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(21)
    a, b, c = (family(rng, 80, 4, 1) for _ in range(3))
    rows = [(3, a[0]), (5, a[0]), (5, b[0]), (9, b[0]), (11, a[1]), (12, b[1]), (12, ""), (13, c[0]), (13, None), (14, c[1]), (20, c[2]), (20, a[2]), (21, "alone"), (21, "alone"), (22, "x"), (22, "y")]
    for k in range(30):  # an id with many texts of its own
        rows += [(40, f"text {k} of one id"), (50 + k, f"text {k} of one id")]
    rng.shuffle(rows)
    components, _ = brute([t for _, t in rows])
    top = {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (d, _) in enumerate(rows):
        x, y = find(d), find(rows[components[k]][0])
        top[max(x, y)] = min(x, y)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, find(d)) for d, _ in rows)
    assert find(9) == 3 == find(14) and find(79) == 40
    kept = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {d for d, _ in rows if find(d) == d}


def test_kinds_of_ids(docs_of):
    docs = docs_of(["a b c d e f"] * 2)
    assert {r.component_id for r in N.near_duplicates(docs.withColumn("doc_id", docs["doc_id"].cast("int"))).collect()} == {0}
    with pytest.raises(TypeError):
        N.near_duplicates(docs.withColumn("doc_id", docs["doc_id"].cast("string")))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = N.op9_minhash(spark, sf)
    assert {f.name: f.dataType.simpleString() for f in out.schema} == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    docs = sorted(((d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=lambda d: d[0])
    components, sizes = brute([t for _, t in docs])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}
    assert got == {i: (sizes[k], docs[components[k]][0], components[k] == k) for k, (i, _) in enumerate(docs)}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        s = N.sketches([a])[0]
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    errors = []
    for n in (10, 100, 2000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
            cut = max(1, len(x) // 10)
            a, b = N.sketches([np.sort(x[cut:]), np.sort(x[:-cut])])
            errors.append((a == b).mean() - (len(x) - 2 * cut) / len(x))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_sketch_does_not_depend_on_the_chunk():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 5, 80, 900)]
    together = N.sketches(sets)
    assert all((N.sketches([s])[0] == t).all() for s, t in zip(sets, together, strict=True))


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(25)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {x for x in top if not any(x in l and l[0] != l[1] for l in links)}
    assert got == {x: find(x) for x in top if x not in alone}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, docs_of):
    rows = N.near_duplicates(odd_docs).collect()
    assert len(rows) == 8
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id in (1, 2, 3, 4)} == {(1, 1), (2, 2), (3, 3), (4, 4)}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert N.drop_near_duplicates(odd_docs).columns == odd_docs.columns
    assert N.near_duplicates(docs_of([])).count() == 0


def test_bands_and_floor_follow_the_similarity():
    assert (N.band_width((85, 100)), N.floor_of((85, 100))) == (7, 181)
    for enough in ((85, 100), (80, 100), (1, 2)):
        s, w = enough[0] / enough[1], N.band_width(enough)
        assert (1 - s**w) ** (N.BINS // w) <= 1e-6
        rng = np.random.default_rng(6)
        equal = rng.binomial(N.BINS, s, 100_000)
        assert (equal >= N.floor_of(enough)).all()
        assert N.band_keys(np.zeros((2, N.BINS), np.uint64), w).shape == (2, N.BINS // w)
