"""The pipeline against plain versions of its stages, on planted documents."""

import random

from tokenizers import Tokenizer

import corpus_pipeline
from mojiweave.llm import packing
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_line_dedup import stays
from tests.llm.test_near_dup import brute as groups


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) + ("." if k % 11 == 10 else "") for k in range(n))

    item = prose(14)
    clean = [f"{prose(70)}\n{prose(60)}" for _ in range(40)]
    near = [" ".join(clean[0].split()[:k] + ["swap"] + clean[0].split()[k + 1 :]) for k in (5, 60, 100)]
    texts = clean + near + [clean[3], f"{prose(60)} {item} {prose(60)}", "too short", None, *(" ".join(f"{w}###" for w in prose(90).split()) for _ in range(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in at.collect()}
        assert name == "packing" or at.columns == docs.columns
    short = len(texts) - 8
    assert set(seen["quality_rules"]) == set(range(short))
    left = lines([(i, texts[i]) for i in range(short)])
    kept = [i for i in range(short) if stays(texts[i], left[i])]
    assert {i: r.text for i, r in seen["line_dedup"].items()} == {i: left[i] for i in kept}
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].values())
    component, _ = groups([left[i] for i in kept])
    stay = [i for k, i in enumerate(kept) if component[k] == k]
    assert sorted(seen["near_duplicates"]) == stay
    pure = [i for i in stay if not hits(left[i], [(1, item)])[1]]
    assert sorted(seen["decontamination"]) == pure and set(range(40)) <= set(pure)
    assert set(seen["packing"]) == set(pure)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.piece, r.length) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.length) for r in at.collect())


def test_the_last_stage_gives_ids_that_make_up_sequences(spark, tmp_path):
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) + ("." if k % 11 == 10 else "") for k in range(120)) for _ in range(12)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    placed = corpus_pipeline.run(spark, str(tmp_path))
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = {r.doc_id: r for r in placed.collect()}
    assert all(rows[i].ids == [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts))
    made = packing.sequences(placed).collect()
    assert all(len(s.ids) == sum(s.lengths) <= packing.CAPACITY for s in made) and sum(len(s.ids) for s in made) == sum(len(r.ids) for r in rows.values())


def test_a_lazy_result_outlives_the_next_stage(spark, docs_of):
    docs = docs_of(["one line of text that stands here", "one line of text that stands here", "and another line of text, its own"])
    first = corpus_pipeline.lines(spark, docs, "a")
    second = corpus_pipeline.near_duplicates(spark, first, "a")  # built on what was not written
    assert {r.doc_id for r in second.collect()} == {0, 2} and {r.doc_id for r in first.collect()} == {0, 2}
    assert corpus_pipeline.lines(spark, docs, "b").count() == 2 and second.count() == 2


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_link_from_four_fifths(spark):
    rng = random.Random(80)

    def base():
        return [f"w{rng.randrange(10**6)}" for _ in range(104)]

    def changed(words, places):
        return [f"new{rng.randrange(10**6)}" if k in places else w for k, w in enumerate(words)]

    texts = []
    for _ in range(12):
        w = base()
        texts += [w, changed(w, {20, 60})]  # 10 of 100 shingles: 90 / 110
        w = base()
        texts += [w, changed(w, {102, *range(97, 100), 9, 10})]  # 18 shingles or so: under 0.8
        w = base()[:94]
        texts += [w, changed(w, {30, 33, 36})]  # 11 of 90 shingles: 79 / 101
        w = base()[:49]
        texts += [w, changed(w, {20})]  # 5 of 45 shingles: 40 / 50, just enough
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert any(0.8 <= x < 0.85 for x in alike) and 0.8 in alike and any(0.7 < x < 0.8 for x in alike)
    gone = {j for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(range(len(texts))) - gone
