"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix, and the middle goes last.

A text is decoded to an array of code points. Each has a class of `UNITS`, and a small table says
between which neighbouring classes a unit ends, so the boundaries are the places where the table,
looked up for all neighbours at once, is true. Two ranks drawn from a digest of seed and doc_id
choose two of them; the pieces between are slices of the array, encoded anew.

A text that is empty or holds one of the MARKS stays plain, as do texts that the rate leaves out.
Since no other text holds a mark, and a mark put between pieces cannot make another one with them,
restored() gives every text back exactly.

Work is one pass without a shuffle; a row depends on its doc_id and text alone, so a lost task
gives the same rows again. Defined cases: a null text is empty; a null doc_id is drawn for as the
empty string; rows that repeat a doc_id draw alike; an empty table gives an empty result; other
columns pass unchanged but for those named like the operator's own and for text, which restored() gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.llm import common

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 7
#: Texts whose outputs leave a worker together.
STEP = 500
#: Percent of texts that are transformed, and of those, of the suffix-first form.
RATE, SPM_RATE = 100, 50
#: Kinds of unit: the characters of class 1, and between which classes (left, right) a unit ends.
UNITS = {
    "line": ("\n", ((False, False), (True, True))),
    "word": (common.WHITE, ((False, False), (True, False))),
    "char": ("", ((True, True), (True, True))),
}
OWN = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: str, seed: int) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of a digest, as numbers."""
    h = hashlib.sha256(f"{seed}:{doc_id}".encode("utf-8", "surrogatepass")).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def unit_ends(codes, unit: str):
    """Where the units of an array of code points end, in order; none of an empty one."""
    import numpy as np

    signs, table = UNITS[unit]
    kind = np.isin(codes, [ord(c) for c in signs]).astype(np.int8)
    inner = np.flatnonzero(np.asarray(table)[kind[:-1], kind[1:]]) + 1
    return np.append(inner, len(codes)) if len(codes) else inner


def cut(text: str, doc_id: str, unit: str, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = unit_ends(codes, unit)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    at = np.append(0, ends)
    a, b = sorted((int(at[h1 % (n + 1)]), int(at[h2 % (n + 1)])))
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le") for x in (codes[:a], codes[a:b], codes[b:]))
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs without text, with n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    own = [x.split()[0] for x in OWN.split(", ")]
    out = [c for c in docs.columns if c not in {"text", *own}]
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in out)).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in (b.slice(k, STEP) for b in batches for k in range(0, b.num_rows, STEP)):
            row = batch.column("row")
            found = [cut(t.as_py(), k.as_py(), unit, seed, rate, spm_rate) for t, k in zip(batch.column("text"), batch.column("key"), strict=True)]
            made = zip(*found, strict=True) if found else ((),) * len(own)
            yield pa.RecordBatch.from_arrays([*(row.field(c) for c in out), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], [*out, *own])

    return common.map_arrow(source, run, f"{common.ddl(docs, 'text', *own)}, {OWN}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""

    # each mark stands there once: what is between them is cut out by bytes
    def pieces(first: str, second: str) -> tuple[Column, Column]:
        after = F.substring_index(output, second, -1)
        return F.substring_index(F.substring(output, 1 + len(first), 1 << 30), second, 1), F.substring_index(after, MIDDLE, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    (p1, s1), (s2, p2) = pieces(PREFIX, SUFFIX), pieces(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(p1, middle, s1)).otherwise(F.concat(p2, middle, s2))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(u) AS n, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain,
    least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN NOT plain THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE WHEN plain THEN text WHEN h4 % 100 < 50 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""
