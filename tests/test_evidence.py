"""Symbol evidence and anchors as joins against the scan and the greedy choice of the sessions."""

import random

from mojiweave.operators import orthography, phonetic_sessions
from mojiweave.plans import phonetic_first as P
from mojiweave.sources.fixed import ENTRIES

WORDS = [e.raw for e in ENTRIES] + ["purchase", "node.js", "c++", "c#", "kyou", "zq", "1", "foo_bar", "a.b.c", "x@y.z", "xwo", "kyouubuntuwotukau", "kyouinvite", "issuewo", "http://", "www.", "nodejswotukau", "k-pop", "--", "a-", "#"]


def texts_of(spark, n, seed):
    rng = random.Random(seed)
    texts = {"".join(rng.choice(WORDS) + rng.choice(["", "", "", " ", ".", "-", "@", "、", "(", ":"]) for _ in range(rng.randrange(1, 6))) for _ in range(n)} | {"", ".", "a.", ".a", "a.b", "a..b", "a.wo", "zq.zqwo"}
    return sorted(texts), spark.createDataFrame([(t,) for t in sorted(texts)] * 2 + [(None,)], "text string")


def test_symbol_evidence_is_that_of_the_scan(spark):
    texts, df = texts_of(spark, 150, 3)
    out = orthography.symbol_evidence(df)
    assert "Python" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted((t, *e) for t in texts for e in orthography.evidence(t))


def test_anchors_are_those_of_the_sessions(spark):
    texts, df = texts_of(spark, 150, 5)
    p = P.PhoneticParameters()
    out = phonetic_sessions.anchors(df, p)
    assert "Python" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(tuple(r) for r in out.collect())
    want = sorted((t, *a) for t in texts for a in P.anchors(t, P.symbols_of(t), p))
    assert [(*x[:4], round(x[4], 9), round(x[5], 9), x[6]) for x in got] == [(*x[:4], round(x[4], 9), round(x[5], 9), x[6]) for x in want]
    assert {x[6] for x in got} == {"orthographic", "anomaly", "contextual"}


def test_unresolved_share_is_that_of_the_units(spark):
    from mojiweave.functions import phonetic
    from mojiweave.plans import reading as R

    texts, df = texts_of(spark, 300, 7)
    more = [a + b + c for a in ("", "s", "n", "kk", "x1") for b in ("ny", "nn", "nny", "sh", "tt", "hh", "y", "ka") for c in ("", "n", "h", "ky", "ts")]
    got = {t: u for t, u in df.unionByName(spark.createDataFrame([(t,) for t in more], "text string")).filter("text is not null").select("text", phonetic.unresolved("text")).collect()}
    assert all(abs(got[t] - R.unresolved(t)) < 1e-12 for t in [*texts, *more])


def test_anchors_meet_entries_and_symbols_in_one_shuffle(spark):
    """Two shuffles of texts (distinct, dealt) and one in which what stands in a text comes together: no join on texts."""
    _, df = texts_of(spark, 20, 9)
    plan = phonetic_sessions.anchors(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == plan.count("Join ") and "Window" not in plan and plan.count("Join ") == 1
