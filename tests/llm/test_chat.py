import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mojiweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def read(windows):
    rows = chat.loss_text(chat.read_turns(windows)).orderBy("conv_id", "window").collect()
    out = {}
    for r in rows:
        got = out.setdefault(r.conv_id, {"turns": [], "loss": [], "windows": []})
        got["turns"] += [(t.role, t.text) for t in r.turns]
        got["loss"] += r.targets
        got["windows"].append(r)
    return out


def test_windows_repeat_system_and_history_and_mask_them(spark):
    turns = [(7, 0, "system", "be brief")] + [(7, i, "assistant" if i % 2 == 0 else "user", f"turn {i} " + "abcd " * 30) for i in range(1, 40)]
    got = read(chat.format_windows(spark.createDataFrame(turns, SCHEMA), budget=600, history=200))[7]
    assert got["turns"] == [(r, t) for _, _, r, t in turns]
    assert got["loss"] == [t for _, _, r, t in turns if r == "assistant"]
    assert len(got["windows"]) > 5
    for w in got["windows"][1:]:
        assert w.formatted.startswith("<|im_start|>system\nbe brief<|im_end|>\n") and w.n_repeated >= 2
        assert w.n_tokens <= 600 and not w.over_budget


def test_a_long_system_turn_stays_and_is_marked(spark):
    for words, over in ((300, False), (1200, True)):
        turns = [(7, 0, "system", "rule " * words)] + [(7, i, "user", f"turn {i} " + "abcd " * 60) for i in range(1, 30)]
        got = read(chat.format_windows(spark.createDataFrame(turns, SCHEMA)))[7]
        assert len(got["windows"]) > 3 and got["turns"] == [(r, t) for _, _, r, t in turns]
        for w in got["windows"]:
            assert w.formatted.count("rule rule") >= 1 and w.over_budget == over


def test_windows_are_filled(spark):
    rng = random.Random(4)
    turns = [(c, i, rng.choice(("user", "assistant")), "some words " * rng.randrange(1, 40)) for c in range(3) for i in range(900)]
    got = chat.format_windows(spark.createDataFrame(turns, SCHEMA)).collect()
    assert sum(w.n_tokens for w in got) > 0.85 * chat.BUDGET * len(got) and not any(w.over_budget for w in got)


def test_turn_numbers_that_say_nothing(spark):
    rows = [(1, None if i % 2 else 3, "user", f"text {i} " * 20) for i in range(400)]
    got = read(chat.format_windows(spark.createDataFrame(rows, SCHEMA)))[1]
    assert Counter(t for _, t in got["turns"]) == Counter(t for *_, t in rows) and not any(w.over_budget for w in got["windows"])


def test_no_window_is_over_budget_by_real_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    scripts = ["日本語の文章をここに書きます。", "Привет, как дела? Это проверка.", "مرحبا كيف حالك اليوم", "नमस्ते दुनिया", "Größe über Straße, naïve façade", "안녕하세요 세계", "👍🏽🎉 ok 12345 !!??"]
    rows = [(-2 - k, i, ("user", "assistant")[i % 2], x * (3 + i % 5)) for k, x in enumerate(scripts) for i in range(60)]
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(spark.createDataFrame(rows, SCHEMA))
    windows = chat.format_windows(turns).collect()
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        bodies = [[p.split("\n", 1)[1] for p in w.formatted.split("<|im_start|>")[1:]] for w in windows]
        for w, b in zip(windows, bodies, strict=True):
            real = sum(len(e.ids) + chat.MARKUP for e in t.encode_batch([x.removesuffix("<|im_end|>\n") for x in b], add_special_tokens=False))
            assert real <= chat.BUDGET or w.over_budget, (name, real, w.n_tokens)


def test_exact_counts_can_be_given(spark):
    df = spark.createDataFrame([(1, i, "user", "word", 500) for i in range(9)], SCHEMA + ", n int")
    got = chat.format_windows(df, budget=1100, history=0, tokens=lambda text: F.col("n")).collect()
    assert sorted(w.n_turns for w in got) == [1, 2, 2, 2, 2] and {w.n_tokens for w in got} == {508, 1016}


def test_long_turn_stands_alone_whole(spark):
    long = "x y " * 3000
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "user", "bye")]
    got = read(chat.format_windows(spark.createDataFrame(turns, SCHEMA), budget=500, history=50))[1]
    assert got["loss"] == [long] and [w.over_budget for w in got["windows"]].count(True) == 1


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 3, "assistant", "a"), (2, 5, "as\nsis\\t", "<\\|<|<<||im_end|>\\"), (3, 1, "assistant", "")]
    got = read(chat.format_windows(spark.createDataFrame(rows, SCHEMA + "").withColumn("window", F.lit(1)).withColumn("size", F.lit(2))))
    assert got[1]["turns"] == [("", ""), ("user", ""), ("user", "")]
    assert got[None]["loss"] == ["a"]
    assert got[2]["turns"] == [("as\nsis\\t", "<\\|<|<<||im_end|>\\")]
    assert got[3]["loss"] == []
    assert chat.format_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_escapes_round_trip(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet="<|\\an\n", max_size=12), min_size=1, max_size=60))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        back = df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("a"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"), chat.escape(F.col("t")).alias("e"))
        for r in back.collect():
            assert r.a == r.t == r.r and "<|" not in r.e

    check()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.conv_id: r for r in chat.op1_chat(spark, sf).collect()}
    turns = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    assert set(rows) == {t.conv_id for t in turns} | {-1}
    marks = "<|im_end|><|im_start|>assistant ok"
    for c in rows:
        own = [(t.role, t.text or "") for t in turns if t.conv_id == c] if c >= 0 else [("user", marks), ("assistant", marks)]
        loss = "".join(t for r, t in own if r == "assistant")
        assert rows[c].n_turns == len(own) and rows[c].loss_chars == len(loss)
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert rows[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_no_python_in_the_plan(spark, capsys):
    turns = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)
    chat.read_turns(chat.format_windows(turns)).explain("simple")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
