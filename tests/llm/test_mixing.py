import random
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from mojiweave.llm import mixing as M

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights, budget, most):
    """Shares by weight, in exact fractions; sources in their order."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full: set = set()
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        total = sum(w[s] for s in names if s not in full)
        got = {s: Fraction(most * sizes[s]) if s in full else Fraction(rest * w[s], total) for s in names}
        more = {s for s in names if got[s] > most * sizes[s]}
        if not more or not total:
            return got
        full |= more


def docs_by_source(spark, counts, rng, longest=60):
    rows = []
    for s, n in counts.items():
        rows += [(len(rows) + k, " ".join(["w"] * rng.randrange(longest)), s) for k in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("counts", [{"a": 300, "b": 40, "c": 40, "d": 5}, {"a": 3, "b": 3, "É": 200, "z": 4, None: 30, "": 7}, {"one": 20}, {"a": 5, "b": 5, "c": 5, "hot": 400}])
def test_sources_come_near_their_targets(spark, counts):
    rows, docs = docs_by_source(spark, counts, random.Random(len(counts)))
    got = M.mix_plan(docs).collect()
    size, most, taken, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    source_of = {d: s for d, _, s in rows}
    for r in got:
        s = source_of[r.doc_id]
        size[s] += r.size
        most[s] = max(most[s], r.size)
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(size, M.WEIGHTS, sum(size.values()), 3)
    assert sum(taken.values()) == sum(size.values())
    for s in size:
        assert target[s] == pytest.approx(float(want[s]), rel=1e-12)
        assert abs(taken[s] - target[s]) <= 2 * max(most.values()) and all(r.source_size == size[s] for r in got if source_of[r.doc_id] == s)
    assert sorted(map(tuple, M.mix_plan(docs.repartition(7)).collect())) == sorted(map(tuple, got))


def test_the_mix_itself(spark):
    rows, docs = docs_by_source(spark, {"a": 60, "b": 12, "c": 9}, random.Random(2))
    docs = docs.withColumn("mix_copy", F.lit("x")).withColumn("size", F.lit(-1))
    plan = {r.doc_id: r for r in M.mix_plan(docs).collect()}
    mix = M.mixture(docs)
    assert mix.columns == ["doc_id", "text", "source", "size", "mix_copy", "mix_time"]
    copies = mix.collect()
    assert [r.mix_time for r in copies] == sorted(r.mix_time for r in copies)
    words, text_of = defaultdict(int), {d: t for d, t, _ in rows}
    for r in copies:
        words[r.doc_id] += len(r.text.split())
        assert text_of[r.doc_id].startswith(r.text)
    assert {d: n for d, n in words.items() if n} == {d: r.taken for d, r in plan.items() if r.taken}
    assert sum(r.text != text_of[r.doc_id] for r in copies) <= 1
    assert {r.mix_copy for r in copies} <= {0, 1, 2}


def test_shares_and_repeats(spark):
    rows, docs = docs_by_source(spark, {"a": 80, "b": 80}, random.Random(4))
    total = sum(len(t.split()) for _, t, _ in rows)
    assert M.mix_plan(docs, (1, 1), (1, 2)).agg(F.sum("taken")).first()[0] == total // 2
    once = M.mix_plan(docs, (9, 1), (1, 1), most_repeats=1).collect()
    assert all(r.taken == r.size for r in once)
    assert M.mix_plan(docs, share=(5, 1)).filter("taken != 3 * size").count() == 0
    assert sorted(map(tuple, M.mix_plan(docs, seed=1).collect())) != sorted(map(tuple, M.mix_plan(docs, seed=2).collect()))


@pytest.mark.parametrize("text", [None, "", " \t\n\v\f\r ", "a", " a b ", "a\x1cb c　d", "x\n\ny\tz", "é " * 40])
def test_words(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(M.n_words(F.col("t"))).first()[0] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_odd_rows(spark, odd_docs, docs_of):
    docs = odd_docs.withColumn("source", F.when(F.col("doc_id") == 6, "s"))
    rows = M.mix_plan(docs).collect()
    assert len(rows) == 8 and {r.taken for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert sum(r.taken for r in rows) == sum(r.size for r in rows)
    assert M.mix_plan(docs_of([])).count() == 0
    empty = M.mix_plan(docs_of(["", None, " "])).collect()
    assert {tuple(r)[1:] for r in empty} == {(0, 0, 0.0, 0)} and len(empty) == 3
    twice = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (1, "d", "x"), (2, "e f", "y")], "doc_id long, text string, source string")
    assert sum(r.taken for r in M.mix_plan(twice).collect()) == 9


def test_query_against_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    out = M.op13_mixing(spark, SF)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted(db.sql(M.OP13_SQL).fetchall())
