import hashlib
import random
import re

import duckdb
import pytest

from mojiweave.llm import decontamination as D

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for k, item in items:
        x = words(item)
        m = min(10, len(x))
        if not m:
            continue
        windows = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(k)
    return len(w), len(hit), found


@pytest.mark.parametrize("broadcast_rows", [D.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, docs_of, broadcast_rows):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "éa", "x-y", "A"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 7, 9, 10, 11, 14, 30])))) for i in range(25)] + [(99, None), (7, "w1 w2 w3 w1 w1 w1 w2 w9 w9 w9 w1")]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(25))) for _ in range(2)]
        item = words(rng.choice(items)[1])
        a = rng.randrange(len(item) + 1)
        parts.insert(1, ", ".join(item[a : a + rng.randrange(8, 16)]).upper())
        texts.append(" | ".join(parts))
    texts += [None, "", "!!", "same " * 40]
    got = {r.doc_id: r for r in D.find_hits(docs_of(texts), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute(t, items)
        marked = {p for s in got[i].spans for p in range(s.start, s.start + s.length)}
        assert (got[i].n_words, len(marked), set(got[i].items)) == (n, hit, found), t


def test_query_against_sql(spark):
    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = sorted(map(tuple, D.op10_decontamination(spark, sf).collect()))
    assert rows == sorted(db.sql(D.OP10_SQL).fetchall())
    assert any(r[-1] for r in rows) and hashlib.sha256(b"").hexdigest() in {r[4] for r in rows}


def test_odd_rows(spark, odd_docs, docs_of):
    empty, one = (spark.createDataFrame(x, "item_id long, text string") for x in ([], [(1, "seven wizards brew a potent potion"), (None, "the lazy dog")]))
    assert all(not r.spans for r in D.find_hits(odd_docs, empty).collect())
    rows = D.find_hits(odd_docs, one).collect()
    assert len(rows) == 8 and sum(bool(r.spans) for r in rows) == 4 and all(r["items"] == [1] for r in rows if r.spans)
    kept = D.drop_contaminated(odd_docs, one)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert D.find_hits(docs_of([]), one).count() == 0 and D.drop_contaminated(docs_of([]), empty).count() == 0


def test_no_python_in_the_plan(spark, docs_of, capsys):
    D.find_hits(docs_of(["a b"]), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).explain("simple")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_documents_meet_no_fingerprint_as_such_on_the_shuffle_path(spark, docs_of):
    """The joins of the shuffle path are inner joins: no row of a document without a fingerprint takes part."""
    docs, items = docs_of([" ".join(f"w{k}" for k in range(30)), None, "", "one two"]), spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(5, 18)))], "item_id long, text string")
    out = D.find_hits(docs, items, 0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and plan.count("Join Inner") >= 2
    assert sorted((r.doc_id, r.n_words, len(r.spans)) for r in out.collect()) == [(0, 30, 4), (1, 0, 0), (2, 0, 0), (3, 2, 0)]
