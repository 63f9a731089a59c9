"""Joins of intervals against all pairs; ripples and consensus against the sessions and single prefixes."""

import random

import pytest

from mojiweave.operators import intervals, phonetic_sessions, ripples
from mojiweave.plans import consensus as C
from mojiweave.sources import scratch
from mojiweave.sources.fixed import ENTRIES


@pytest.mark.parametrize("radius,cell", [(0, None), (6, None), (6, 1), (3, 50)])
def test_band_join_against_all_pairs(spark, radius, cell):
    rng = random.Random(radius + (cell or 0))

    def rows(n, longest):
        out = []
        for i in range(n):
            a = rng.randrange(-30, 200)
            out.append((i, rng.choice("xy"), a, a + rng.randrange(longest)))
        return out

    left, right = rows(120, 40), rows(120, 12)
    df = spark.createDataFrame(left, "i int, k string, start int, end int")
    got = intervals.band_join(df, spark.createDataFrame(right, "j int, k string, source_start int, source_end int"), ["k"], radius, cell)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Inner, (" in plan
    want = [(i, j, max(0, c - b, a - d)) for i, k, a, b in left for j, m, c, d in right if k == m and max(0, c - b, a - d) <= radius]
    assert sorted((r.i, r.j, r.distance) for r in got.collect()) == sorted(want) and want


def test_stab_join_against_all_pairs(spark):
    rng = random.Random(4)
    left = [(i, rng.choice("xy"), a, a + rng.randrange(60)) for i in range(80) for a in [rng.randrange(-20, 100)]]
    points = [(j, rng.choice("xy"), rng.randrange(-20, 140)) for j in range(80)]
    got = intervals.stab_join(spark.createDataFrame(left, "i int, k string, start int, end int"), spark.createDataFrame(points, "j int, k string, point int"), ["k"])
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, k, a, b in left for j, m, p in points if k == m and a < p < b)


def test_ripples_are_those_of_the_sessions(spark):
    rng = random.Random(11)
    words = [e.raw for e in ENTRIES] + ["purchase", "node.js", "c++", "kyou", "zq", "1", "(", "foo_"]
    texts = spark.createDataFrame([("".join(rng.choice(words) + rng.choice(["", "", " ", "。"]) for _ in range(rng.randrange(1, 6))),) for _ in range(40)], "text string")
    names = ["text", "step", "source_start", "source_end", "source_kind", "strength", "affected_start", "affected_end", "reason"]

    def listed(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())

    got = ripples.ripple_events(scratch.written(ripples.reads(texts)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "BroadcastNestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert listed(got) == listed(phonetic_sessions.events(phonetic_sessions.phonetic_steps(texts), "ripple_events"))


def random_letters(rng):
    if rng.random() < 0.6:
        return "".join(rng.choice([e.raw for e in ENTRIES]) for _ in range(rng.randrange(1, 5)))[: rng.randrange(1, 22)]
    return "".join(rng.choice("aknoudseyh") for _ in range(rng.randrange(1, 14)))


def test_prefixes_share_what_each_would_find_alone():
    rng = random.Random(3)
    for _ in range(60):
        text = random_letters(rng)
        for width in (64, 4):
            shared = list(C.beams(text, width))
            assert [list(C.beams(text[:m], width))[-1] for m in range(1, len(text) + 1)] == shared, text
        assert [list(C.throughs(text[:m]))[-1] for m in range(1, len(text) + 1)] == list(C.throughs(text)), text


def test_the_beam_holds_the_best_of_all_readings():
    """All readings of short texts, one by one: the best score, and the best through each place."""
    rng = random.Random(8)
    for _ in range(40):
        text = random_letters(rng)[:7]
        n = len(text)

        def follow(at, before):
            if at == n:
                yield 0.0, []
                return
            for c in [*C.whole(text, at), *C.begun(text, at), C.unknown(text, at)]:
                for score, path in follow(c.end, c):
                    yield c.score + C.transition(before, c) - 0.55 + score, [c, *path]

        found = list(follow(0, None))
        assert max(s for s, _ in found) == pytest.approx(list(C.beams(text, 10_000))[-1][0][0], abs=1e-9)
        assert len(found) == len(list(C.beams(text, 10_000))[-1])
        worth = [(sum(map(C._worth, path)), {c.end for c in path}) for _, path in found]
        best = max(w for w, _ in worth)
        through = list(C.throughs(text))[-1]
        for i in range(1, n + 1):
            own = max((w for w, ends in worth if i in ends), default=None)
            assert through[i - 1] == pytest.approx(0.0 if own is None else min(1.0, 2.718281828459045 ** (min(0.0, own - best) / 1.35)), abs=1e-9)
