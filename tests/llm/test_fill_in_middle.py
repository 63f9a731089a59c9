import hashlib
import random
import re

import duckdb
import pytest

from mojiweave.llm import fill_in_middle as M

SF = "/root/testdata/sf0.001"


def plain(doc_id, text, pattern=r"[^\n]*\n|[^\n]+", seed=7, rate=100, spm=50):
    """The transformation by a regular expression over units."""
    text = text or ""
    units = re.findall(pattern, text, re.S)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "a\nb", "a\r\nb\x0b\x85 c\n", "😀\n日本\n\né", "has <P> in it", "<S", "x<\n<M", "<M>", "P><S\n>", "﻿bom\n﻿", "\0\n\0", "a\n" * 5000, "no end " * 20000]


@pytest.mark.parametrize("unit,pattern", [("line", r"[^\n]*\n|[^\n]+"), ("char", "."), ("word", r"[^ \t\n\v\f\r]*[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+")])
def test_against_a_regular_expression_and_back(docs_of, unit, pattern):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["a", "\n", " ", "é", "<", "P>", "S", ">", "word ", "日\n"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    out = M.fill_in_middle(docs_of(texts), unit)
    rows = out.withColumn("back", M.restored(out["output"], out["form"])).collect()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, texts[r.doc_id], pattern), texts[r.doc_id]
        assert r.back == (texts[r.doc_id] or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and len(rows) == len(texts)


def test_rates(docs_of):
    docs = docs_of([f"line {k}\nand more\n" for k in range(400)])
    forms = [r.form for r in M.fill_in_middle(docs, rate=60, spm_rate=100).collect()]
    assert 200 < forms.count("spm") < 280 and forms.count("plain") == 400 - forms.count("spm")
    assert {r.form for r in M.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert [r.form for r in M.fill_in_middle(docs, seed=8).collect()] != [r.form for r in M.fill_in_middle(docs).collect()]
    with pytest.raises(ValueError):
        M.fill_in_middle(docs, "page")


def test_odd_rows(odd_docs, docs_of):
    out = M.fill_in_middle(odd_docs)
    assert out.columns == [c for c in odd_docs.columns if c not in ("text", "n")] + ["n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.collect()
    assert len(rows) == 8 and len({tuple(r) for r in rows if r.doc_id == 1}) == 1
    assert {r.output for r in rows if r.doc_id in (2, 3)} == {""}
    assert M.fill_in_middle(docs_of([])).count() == 0


def test_query_against_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = sorted(map(tuple, M.op12_fill_in_middle(spark, SF).collect()))
    assert rows == sorted(db.sql(M.OP12_SQL).fetchall())
    assert {r[2] for r in rows} == {"psm", "spm"} or {r[2] for r in rows} == {"plain", "psm", "spm"}
