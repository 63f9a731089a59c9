"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The labelled rows (at most MOST_LABELLED of them) are dealt into FOLDS by a hash. Two lexicons, of
words and of words' first PREFIX letters, hold the terms that documents labelled toxic use far more
often than others. The features of a labelled document come from lexicons learned without its
fold: densities of both, their hits near a word of address, capitals, punctuation, disguised words.
Trees are fitted to them, and isotonic regression is fitted to margins from trees that did not see
the fold. Lexicons and trees of all folds then score every whole text.

Labels, lang, source and doc_id are no input of a score. Defined cases: a null or empty text has the
features of no word and gets a score like any other; if labels of either kind are missing, the
score is the share of toxic labels (0 without any); a null doc_id is scored, and is not held out;
an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.llm import common
from mojiweave.llm.labelled import labelled_sample, remainder

MOST_LABELLED = 20_000
#: Letters of a prefix.
PREFIX = 4
LEAST_DOCS, LEAST_ODDS = 3, 1.5
FOLDS = 5
NEAR = 4
#: Words that a worker remembers what they say of.
CACHE_WORDS = 400_000
#: Words that address the reader, in the languages of the corpus.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "ta", "vous", "votre", "tú", "ti", "tus", "usted", "ustedes", "vosotros")
#: What disguises letters.
LEET = str.maketrans("013457@$!*", "oleastasi_")
FEATURES = ("word_density", "word_hits", "word_most", "prefix_density", "prefix_hits", "prefix_most", "near_you", "you_density", "capitals", "shouted_words", "exclaim", "punctuation", "disguised", "disguised_hits", "log_words")


@dataclass(frozen=True)
class Lexicon:
    """Words and words' first letters with their log-odds."""

    words: dict[str, float]
    prefixes: dict[str, float]


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\W_][\w@$*!']*", text.lower())


class Terms(dict):
    """What a word says under a lexicon: (its weight, its prefix's, whether it addresses the reader, whether it is disguised, and as a word of the lexicon); PLAIN if nothing."""

    PLAIN = (0.0, 0.0, False, False, False)

    def __init__(self, lexicon: Lexicon):
        import re

        super().__init__()
        self._lexicon, self._odd = lexicon, re.compile(r"[^\W\d_][0-9@$*!]+[^\W\d_]").search

    def __missing__(self, word: str) -> tuple:
        if len(self) >= CACHE_WORDS:
            self.clear()
        known, odd = self._lexicon, bool(self._odd(word))
        said = (known.words.get(word.rstrip("!*'"), 0.0), known.prefixes.get(word[:PREFIX], 0.0), word in SECOND_PERSON, odd, odd and word.translate(LEET) in known.words)
        self[word] = said = said if any(said) else self.PLAIN
        return said


def features(text: str, terms: Terms) -> list[float]:
    """The numbers of FEATURES for a whole text."""
    import math
    import re

    words = _words(text)
    n, plain = max(1, len(words)), Terms.PLAIN
    said = [(i, x) for i, x in enumerate(map(terms.__getitem__, words)) if x is not plain]
    w, p = [x[0] for _, x in said if x[0]], [x[1] for _, x in said if x[1]]
    you = [i for i, x in said if x[2]]
    near = sum(any(abs(i - j) <= NEAR for j in _around(you, i)) for i, x in said if x[0] or x[1])
    odd, fixed = sum(x[3] for _, x in said), sum(x[4] for _, x in said)
    size = lambda pattern: sum(map(len, re.findall(pattern, text)))
    return [
        100 * sum(w) / n, float(len(w)), max(w, default=0.0), 100 * sum(p) / n, float(len(p)), max(p, default=0.0),
        near / n * 100, len(you) / n, size(r"[A-ZÀ-ÖØ-Þ]+") / max(1, size(r"[^\W\d_]+")), len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b", text)) / n, text.count("!") / n, size(r"[^\w\s]+") / n, odd / n, float(fixed), math.log1p(len(words)),
    ]


def _around(places: list[int], i: int) -> list[int]:
    from bisect import bisect_left

    k = bisect_left(places, i)
    return places[max(0, k - 1) : k + 1]


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """From rows (text, y, fold): for each fold the lexicon of the other folds, and at last that of all.

    Per term and fold the documents of either kind are counted; a term's weight is its log-odds of
    standing in a toxic document. All terms that are strong enough reach the driver: the sample bounds
    them, as each stands in LEAST_DOCS of its toxic documents at least.
    """

    def run(batches: Iterator) -> Iterator:
        from collections import Counter, defaultdict

        import pyarrow as pa

        counts: dict = defaultdict(Counter)
        for batch in batches:
            for text, y, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "fold")), strict=True):
                words = {x.rstrip("!*'") for x in _words(text)}
                counts[y, fold].update({f"w{x}" for x in words} | {f"p{x[:PREFIX]}" for x in words if len(x) > PREFIX} | {"n"})
        for (y, fold), terms in counts.items():
            names = list(terms)
            for k in range(0, len(names), 50_000):
                part = names[k : k + 50_000]
                n, zero = [terms[t] for t in part], [0] * len(part)
                yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()), "fold": pa.array([fold] * len(part), pa.int64()), "bad": pa.array(n if y else zero, pa.int64()), "good": pa.array(zero if y else n, pa.int64())})

    each = common.map_arrow(rows, run, "term string, fold long, bad long, good long")
    sums = [F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in ("bad", "good")]
    sums += [F.sum(c).alias(f"{c}{FOLDS}") for c in ("bad", "good")]
    terms = common.materialize(each.groupBy("term").agg(*sums), "terms")
    total, out = terms.filter("term = 'n'").first(), []
    for k in range(FOLDS + 1):
        found: dict[str, dict[str, float]] = {"w": {}, "p": {}}
        if total is not None and total[f"bad{k}"] and total[f"good{k}"]:
            bad, good = F.col(f"bad{k}"), F.col(f"good{k}")
            odds = F.log((bad + 0.1) / (total[f"bad{k}"] + 0.2)) - F.log((good + 0.5) / (total[f"good{k}"] + 1.0))
            strong = terms.filter((F.col("term") != "n") & (bad >= LEAST_DOCS)).select("term", odds.alias("odds"), bad.alias("bad")).filter(F.col("odds") >= LEAST_ODDS)
            for r in strong.select("term", "odds").toLocalIterator():
                found[r["term"][0]][r["term"][1:]] = float(r["odds"])
        out.append(Lexicon(found["w"], found["p"]))
    return out


@dataclass
class Boosted:
    """Trees of a fixed depth on binned features, logistic loss."""

    depth: int = 3
    rounds: int = 80
    rate: float = 0.15
    bins: int = 64
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    base: float = 0.0

    def _binned(self, x):
        import numpy as np

        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x, y):
        import numpy as np

        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        f, width = np.full(len(y), self.base), self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            leaf, splits = np.zeros(len(y), dtype=np.int64), []
            for level in range(self.depth):
                n = 1 << level
                best = np.full(n, 1e-9), np.zeros(n, dtype=np.int64), np.full(n, self.bins, dtype=np.int64)
                for k in range(x.shape[1]):
                    at = leaf * width + b[:, k]
                    gs = np.bincount(at, g, n * width).reshape(n, width).cumsum(axis=1)
                    hs = np.bincount(at, h, n * width).reshape(n, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(n), top]
                    better = value > best[0]
                    best[0][better], best[1][better], best[2][better] = value[better], k, top[better]
                splits.append((best[1], best[2]))
                leaf = leaf * 2 + (b[np.arange(len(y)), best[1][leaf]] > best[2][leaf])
            n = 1 << self.depth
            value = self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1)
            self.trees.append((splits, value))
            f += value[leaf]
        return self

    def margin(self, x):
        import numpy as np

        f = np.full(len(x), self.base)
        if not len(x):
            return f
        b = self._binned(x)
        for splits, value in self.trees:
            leaf = np.zeros(len(x), dtype=np.int64)
            for k, cut in splits:
                leaf = leaf * 2 + (b[np.arange(len(x)), k[leaf]] > cut[leaf])
            f += value[leaf]
        return f


def isotonic(x, y):
    """Pool adjacent violators: (knots, values) of the nondecreasing least-squares fit."""
    import numpy as np

    order = np.argsort(x, kind="stable")
    xs, blocks = np.asarray(x, float)[order], []
    for a, b in zip(xs, np.asarray(y, float)[order], strict=True):
        if blocks and blocks[-1][1] == a:
            blocks[-1][2] += b
            blocks[-1][3] += 1
        else:
            blocks.append([a, a, b, 1])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1][1:] = [last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    knots = np.asarray([v for lo, hi, _, _ in blocks for v in (lo, hi)])
    # half an observation of doubt at either end keeps a score off 0 and 1
    values = np.repeat([(s + 0.01) / (n + 0.02) for _, _, s, n in blocks], 2)
    return knots, np.maximum.accumulate(values)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    knots: object = None
    values: object = None
    prior: float = 0.0
    terms: Terms | None = None

    def score(self, texts: list[str]):
        import numpy as np

        if self.trees is None:
            return np.full(len(texts), self.prior)
        if self.terms is None:
            self.terms = Terms(self.lexicon)
        x = np.asarray([features(t, self.terms) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.values), 0, 1)


@common.scratch()
def fit(sample: DataFrame) -> Model:
    """From labelled rows (doc_id, text, y); the driver gets the lexicons and the features of a bounded sample."""
    import numpy as np

    rows = common.materialize(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS))), "labelled")
    lexicons = sample.sparkSession.sparkContext.broadcast(learn_lexicons(rows))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        terms = [Terms(x) for x in lexicons.value]
        for batch in batches:
            x = np.asarray([features(t.as_py(), terms[k.as_py()]) for t, k in zip(batch.column("text"), batch.column("fold"), strict=True)], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("y"), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(FEATURES)))], ["fold", "y", *FEATURES])

    got = common.map_arrow(rows, run, "fold long, y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    got = got.sort_values(list(got.columns))
    x, y, fold = got[list(FEATURES)].to_numpy(), got["y"].to_numpy().astype(float), got["fold"].to_numpy()
    prior = float(y.mean()) if len(y) else 0.0
    if not 0 < prior < 1:
        return Model(lexicons.value[-1], None, prior=prior)
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        if own.any() and not own.all():
            margin[own] = Boosted().fit(x[~own], y[~own]).margin(x[own])
    return Model(lexicons.value[-1], Boosted().fit(x, y), *isotonic(margin, y), prior=prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    known = spark.sparkContext.broadcast(model)  # two lexicons of a bounded sample and a fixed number of trees

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(known.value.score([t.as_py() or "" for t in batch.column("text")]), pa.float64())], ["doc_id", "score"])

    return common.map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = fit(labelled_sample(docs, labels, "toxic", remainder(F.col("doc_id"), 4) != 2, MOST_LABELLED))
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
