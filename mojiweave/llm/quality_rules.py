"""Quality rules as weak supervision.

Each rule looks at a few numbers of a whole text and votes good or bad, or abstains. The votes of
all documents that pass the base rules (none of the others needs a verdict) are counted by their
pattern (at most 3 ** len(rules()) rows, whatever the corpus), and
expectation-maximisation over those counts estimates, for each class, how often each rule votes
for it when it votes at all. A document's posterior probability of being good then takes the place
of passing every rule. Nothing is sampled, and no estimate is bounded: the Beta priors below are
worth a stated number of votes, so a rule whose votes the others do not bear out loses its weight.

Defined cases: a null text has no words and fails the base rules; so does an empty one; a null
doc_id is kept as null; repeated rows are judged one by one; an empty table gives an empty result
(the prior accuracies hold); a posterior at the threshold keeps; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.llm import common

SYMBOLS = "#*$%&|<>"
#: Beta priors, as (good, bad) votes that are added to what is counted: of a rule's votes on good documents (it is
#: taken to be right), of its votes on bad ones (it knows nothing of most kinds of junk) and of the share of good documents.
ON_GOOD, ON_BAD, SHARE = (49.0, 1.0), (0.9, 0.1), (9.0, 1.0)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha", "n_distinct", "n_shout", "n_adjacent", "n_stops")


def text_counts(text: str) -> tuple[int, ...]:
    """The numbers that rules look at, in the order of COUNTS."""
    import re

    import numpy as np

    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # ASCII white space only, as the word contract has it
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    repeated = adjacent = 0
    if n >= 2:
        seq = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=n)
        adjacent = int((seq[1:] == seq[:-1]).sum())
    if n >= 3 and len(ids) < n:
        pair = seq[:-1] * len(ids) + seq[1:]
        if len(ids) >= 2_000_000:  # three ids would not fit 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * len(ids) + seq[2:]
        order = np.sort(key)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            hit = np.isin(key, twice)
            mark = np.zeros(n, dtype=bool)
            mark[:-2] |= hit
            mark[1:-1] |= hit
            mark[2:] |= hit
            repeated = int(mark.sum())
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(re.findall("[A-Za-z]", text))
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(re.findall("[A-Z]", text))
    return (
        n,
        len(text) - sum(map(text.count, common.WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        upper,
        letters,
        len(ids),
        text.count("!") + text.count("?"),
        adjacent,
        text.count(".") + text.count(";") + text.count(":"),
    )


def with_counts(docs: DataFrame) -> DataFrame:
    """row, a struct of the columns of docs, and counts, a struct of COUNTS, a row per row of docs."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = np.asarray([text_counts(x.as_py() or "") for x in batch.column("row").field("text")], dtype=np.int64).reshape(-1, len(COUNTS))
            counts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(COUNTS))], list(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("row"), counts], ["row", "counts"])

    rows = common.packed(docs)
    return common.map_arrow(rows, run, f"{common.ddl(rows)}, counts struct<{', '.join(f'{c}: long' for c in COUNTS)}>")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Votes bad (-1) where `bad` holds, else good (1) where `good` holds, else abstains (0)."""

    name: str
    bad: Column | None
    good: Column | None

    def vote(self) -> Column:
        v = F.when(self.bad, -1) if self.bad is not None else F.when(F.lit(False), 0)
        return (v.when(self.good, 1) if self.good is not None else v).otherwise(0).cast("int")


def rules() -> list[Rule]:
    words = F.col("n_words")
    symbols, upper, repeats = _share("n_symbols", "n_words"), _share("n_upper", "n_alpha"), _share("n_repeat_words", "n_words")
    shouts, dup, mean, near = _share("n_shout", "n_words"), _share("n_dup_lines", "n_lines"), _share("word_chars", "n_words"), _share("n_adjacent", "n_words")
    alpha, kinds = _share("n_alpha", "word_chars"), _share("n_distinct", "n_words")
    return [
        Rule("length", None, words >= 80),
        Rule("symbols", symbols > 0.15, symbols < 0.05),
        Rule("capitals", upper > 0.35, upper < 0.12),
        Rule("repeats", repeats > 0.35, repeats < 0.10),
        Rule("shouting", shouts > 0.25, shouts < 0.05),
        Rule("duplicate_lines", dup > 0.5, (dup < 0.1) & (F.col("n_lines") >= 3)),
        Rule("word_length", (mean < 2) | (mean > 15), mean.between(3, 9)),
        Rule("stutter", near > 0.15, near < 0.03),
        Rule("letters", alpha < 0.6, alpha > 0.85),
        Rule("variety", (kinds < 0.1) & (words < 2000), kinds > 0.4),
    ]


def fit_em(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 500):
    """Per class the share of good votes among a rule's votes, the share of good documents, and each pattern's posterior.

    patterns: votes (-1, 0, 1) with their count. The first guess is that one bad vote speaks for a
    bad document; the rounds then find how far each rule can be trusted. A rule that often votes
    bad where the others see nothing wrong is found to vote alike on both classes and decides nothing.
    """
    import numpy as np

    votes = np.asarray([p for p, _ in patterns], dtype=np.int64).reshape(-1, n_rules)
    n = np.asarray([c for _, c in patterns], dtype=np.float64)
    good, bad = (votes == 1).astype(float), (votes == -1).astype(float)
    q = np.where(bad.any(axis=1), 0.02, 0.98)
    p_good, p_bad, prior = np.full(n_rules, ON_GOOD[0] / sum(ON_GOOD)), np.full(n_rules, ON_BAD[0] / sum(ON_BAD)), SHARE[0] / sum(SHARE)
    for _ in range(rounds if len(n) else 0):
        before = q
        a, b = n * q, n * (1 - q)
        p_good = (a @ good + ON_GOOD[0]) / (a @ (good + bad) + sum(ON_GOOD))
        p_bad = np.minimum(p_good, (b @ good + ON_BAD[0]) / (b @ (good + bad) + sum(ON_BAD)))  # at worst a rule says nothing
        prior = float((a.sum() + SHARE[0]) / (n.sum() + sum(SHARE)))
        x = np.log(prior) + good @ np.log(p_good) + bad @ np.log(1 - p_good)
        y = np.log(1 - prior) + good @ np.log(p_bad) + bad @ np.log(1 - p_bad)
        q = 1 / (1 + np.exp(np.clip(y - x, -700, 700)))
        if np.abs(q - before).max() < 1e-9:
            break
    return p_good, p_bad, prior, q


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _votes() -> dict[str, Column]:
    return {f"vote_{r.name}": r.vote() for r in rules()}


def fit(counted: DataFrame) -> DataFrame:
    """(vote_<rule>..., p_good) of every pattern of votes among the rows of counted (COUNTS) that pass the base rules."""
    names = list(_votes())
    rows = counted.filter(~_failed()).select(*(v.alias(k) for k, v in _votes().items())).groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    rows.sort(key=lambda r: tuple(r)[:-1])
    *_, prob = fit_em([(tuple(r)[:-1], r["count"]) for r in rows], len(names))
    return counted.sparkSession.createDataFrame([(*tuple(r)[:-1], float(p)) for r, p in zip(rows, prob, strict=True)], ", ".join(f"{v} int" for v in names) + ", p_good double")


def _judged(counted: DataFrame, verdicts: DataFrame, threshold: float) -> DataFrame:
    """counted (COUNTS, ...) with vote_<rule>, p_good, base_failed and kept."""
    voted = counted.withColumns(_votes()).join(F.broadcast(verdicts), list(_votes()), "left").withColumn("base_failed", _failed())
    return voted.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("p_good"), F.lit(1.0)) >= threshold))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, vote_<rule>, base_failed, p_good and kept, a row per row of docs."""
    counted = common.materialize(with_counts(docs.select("doc_id", "text")).select("row.doc_id", "counts.*"), "rule_counts")
    return _judged(counted, fit(counted), threshold)


@common.scratch("rejected")
def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, all columns as they were.

    A verdict depends on the text alone: texts are counted once, under a 128-bit digest, and rows
    whose digest was rejected go. Rows that stay are not shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    digest = [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]
    counted = with_counts(docs.select("text", *(d.alias(f"d{i}") for i, d in enumerate(digest)))).select("row.d0", "row.d1", "counts.*")
    counted = common.materialize(counted, "rule_counts")
    gone = _judged(counted, fit(counted), threshold).filter("not kept").select("d0", "d1").distinct()
    return common.drop_matching(docs, digest, common.materialize(gone, "rejected"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judge(common.table(spark, sf_dir, "documents"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
