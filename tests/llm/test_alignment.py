import hashlib
import random
from collections import Counter, defaultdict

import pytest

from mojiweave.llm import alignment as M
from mojiweave.llm import common

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def brute(rows, tokenizers):
    """Every text encoded as a whole, every pair of tokens compared by its bytes."""
    a_of, b_of = tokenizers
    signs = M.byte_alphabet()

    def bytes_a(i):
        t = a_of.id_to_token(i)
        return t.encode() if t == "<|endoftext|>" else bytes(signs[c] for c in t)

    def bytes_b(i):
        p = b_of.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    def one(text):
        if not text:
            return [], [], [], []
        a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
        data, x, y = (" " + text).encode(), [*map(bytes_a, a)], [*map(bytes_b, b)]
        if b"".join(x) != data or b"".join(y) != data:
            return [], [], [], []
        x, y, lo, groups = spans(x), spans(y), 0, []
        for end in sorted({e for _, e in x} & {e for _, e in y}):
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, at, strict=True) if lo <= s and e <= end) for ids, at in ((a, x), (b, y))))
            lo = end
        return a, b, groups, [(i, j) for i, (s, e) in zip(a, x, strict=True) for j, (u, v) in zip(b, y, strict=True) if s < v and u < e]

    made = [(d, *one(t)) for d, t in rows]
    count, top = Counter(p for *_, links in made for p in set(links)), defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [(d, len(a), len(b), len(g), len(ln), sum(count[p] == top[p[0]] for p in ln), sum(count[p] for p in ln), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "", ";".join(g)) for d, a, b, g, ln in made]


ODD = [
    None, "", "a", " a", "a  b", " ", "<|endoftext|> x <s> </s> <unk> <0x41>", "x▁y", "日本語 テキスト です。", "a\0b\x1c c", "naïve café ÀÉ ɏ Ā", "  lead and trail  ", "\n\n a \n b\t c",
    "🤦🏼‍♂️ ok 🤦", "a b c　d e", "!!! ??? ===== ------- ....", "don't can't I'll", "1 22 333 4444 55555", "same " * 300, "= " * 300, "aaaa" * 100 + " " + "ab" * 77,
]


def test_odd_texts_against_brute_force(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["a", "b", " ", "  ", "\n", "é", "日", "1", "'s", ".", "▁" if rng.random() < 0.02 else "z", "THE ", " of"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [*enumerate(texts), (3, "a dup"), (3, "a dup"), (None, "no id")]
    got = M.align(spark.createDataFrame(rows, "doc_id long, text string"), chunk_chars=500).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, tokenizers)))


def test_query_and_counts(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute([(d, t[:800]) for d, t in rows], tokenizers)
    short = docs.selectExpr("doc_id", "substr(text, 1, 800) AS text")
    assert sorted(map(tuple, M.align(short).collect())) == sorted(want)
    pairs = {(r.a, r.b): (r.n, r.top) for r in M.pair_counts(short).collect()}
    assert max(n for n, _ in pairs.values()) > 50 and all(n <= top for n, top in pairs.values())
    out = M.op11_alignment(spark, SF)
    kinds = {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"}
    assert {f.name: f.dataType.simpleString() for f in out.schema} == kinds
    assert out.count() == len(rows)


def test_segments_are_remembered_within_bounds(tokenizers, monkeypatch):
    monkeypatch.setattr(M, "CACHE_CHARS", 5)
    align = M.Aligner(*M.default_tokenizers())
    for text in ("a b c d e f g h i", "one two three four five six seven", "a b one two " * 3, "x" * 100 + " y z"):
        align.ready()
        assert not align._known and not align.names
        for _ in range(2):
            assert align([text])[0][3] == brute([(0, text)], tokenizers)[0][-1]


def test_the_faster_encoder_gives_the_ids_of_the_tokenizer(tokenizers):
    """Every way to cut the vocabulary's own words, and random ones: what is learned together is what a whole text gives."""
    align, rng = M.Aligner(*M.default_tokenizers()), random.Random(12)
    assert align._ranks is not None
    signs = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x250)] if chr(c) not in "×÷"]
    own = [x.decode() for x in align.bytes_a[:50256] if x.isascii() and align._plain(x.decode())]
    words = own + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 12))) for _ in range(8000)] + [rng.choice(own) + rng.choice(own) for _ in range(20000)] + [c * n for c in "a=-.0é" for n in range(1, 90)]
    for k in range(0, len(words), 3000):
        part = words[k : k + 3000]
        found = align([" ".join(part)])[0]
        a = tokenizers[0].encode(" " + " ".join(part), add_special_tokens=False).ids
        assert [int(x) for g in found[3].split(";") for x in g.split("|")[0].split(",")] == a
        assert [int(x) for g in found[3].split(";") for x in g.split("|")[1].split(",")] == tokenizers[1].encode(" ".join(part))


def test_empty_and_odd_tables(odd_docs, docs_of):
    assert M.align(docs_of([])).count() == 0
    rows = M.align(odd_docs).collect()
    assert len(rows) == 8
    assert {(r.n_a, r.groups_sha256) for r in rows if r.doc_id in (2, 3)} == {(0, "")}
    assert len({tuple(r) for r in rows if r.doc_id == 1}) == 1
