"""Quality: nearest-neighbour voting in a latent semantic space.

A text is a bag of terms: its words and their shapes, each hashed to a fixed number of places, and
grades: terms that stand for the share of words that repeat the one before, hold symbols, shout or
have no letter, as that share passes each of GRADES. Document frequencies are counted over all documents.
A bounded sample of labelled documents gives the latent space (a truncated singular value
decomposition of its weighted term rows, by subspace iteration whose products are computed in Spark)
and, projected, the labelled vectors. These are broadcast: MOST_LABELLED x RANK numbers at most. Every
document is then projected, its exact cosines with all labelled vectors are computed in blocks, and
the NEIGHBOURS nearest vote with their similarity; labelled vectors that tie for the last places
share them.

Labels, lang, source and doc_id are no input of a score. Defined cases: a null or empty text has no
direction, so it gets the share of good labels, as does every text if there are no labelled rows
(then 0); a null doc_id is scored, and is not held out; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.llm import common
from mojiweave.llm.labelled import labelled_sample, remainder

MOST_LABELLED, RANK, NEIGHBOURS = 6000, 64, 16
#: Rounds of the subspace iteration, and parts that each send PLACES x (RANK + 8) numbers to the driver in a round.
ROUNDS, PARTS = 4, 8
#: Places for words and for shapes; the last ones are for grades of four traits.
WORD_PLACES, SHAPE_PLACES = 1 << 14, 1 << 10
GRADES, TRAITS = (0.05, 0.15, 0.3, 0.6), 4
PLACES = WORD_PLACES + SHAPE_PLACES + TRAITS * len(GRADES)
#: Documents in a block of cosines; words whose places a worker remembers.
BLOCK, CACHE_WORDS = 256, 400_000
#: Weight of shapes and of grades beside words in a text's direction.
SHAPE_WEIGHT, GRADE_WEIGHT = 3.0, 6.0


def _shape(word: str) -> str:
    """Runs of capitals, other letters and digits as one sign each, anything else as it is, no sign twice in a row."""
    out: list[str] = []
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


class _Places(dict):
    """A word's two places and three of its traits (symbols, capitals, no letter) in one number."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= CACHE_WORDS:
            self.clear()
        plain = word.strip(".,;:!?#$%&*|<>\"'()").lower()
        traits = any(c in "#*$%&|<>" for c in word) + 2 * (len(plain) > 1 and word.upper() == word != word.lower()) + 4 * (not any(map(str.isalpha, word)))
        at = xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) % WORD_PLACES * SHAPE_PLACES + xxh3_64_intdigest(_shape(word).encode("utf-8", "surrogatepass")) % SHAPE_PLACES
        self[word] = at = at * 8 + traits
        return at


def term_counts(text: str, places: dict):
    """(places, counts) of a text's terms."""
    import numpy as np

    words = text.split()
    n = len(words)
    got = np.fromiter(map(places.__getitem__, words), dtype=np.int64, count=n)
    both, traits = got // 8, got % 8
    at, count = np.unique(np.concatenate([both // SHAPE_PLACES, both % SHAPE_PLACES + WORD_PLACES]), return_counts=True)
    if n:
        shares = np.asarray([(both[1:] == both[:-1]).sum(), (traits & 1).sum(), (traits & 2).sum() / 2, (traits & 4).sum() / 4]) / n
        grades = np.flatnonzero((shares[:, None] > np.asarray(GRADES)).ravel()) + WORD_PLACES + SHAPE_PLACES
        at, count = np.concatenate([at, grades]), np.concatenate([count, np.ones(len(grades), dtype=count.dtype)])
    return at, count


def weighted(at, count, idf):
    """Unit-length weights of a text's terms; none: none. Shapes weigh by their share of the words, grades by their rarity alone."""
    import numpy as np

    w = np.log1p(count) * idf[at]
    word, grade = at < WORD_PLACES, at >= WORD_PLACES + SHAPE_PLACES
    shape = ~word & ~grade
    w /= max(1.0, np.sqrt((w[word] ** 2).sum()))
    w[shape] = SHAPE_WEIGHT * np.sqrt(count[shape] / max(1, count[word].sum())) * idf[at[shape]] / 4
    w[grade] = GRADE_WEIGHT * idf[at[grade]] / 4
    n = np.sqrt((w * w).sum())
    return (w / n if n else w).astype(np.float32)


def inverse_frequencies(docs: DataFrame):
    """log((n + 1) / (df + 1)) + 0.1 of every place, over all documents: partitions' counts are summed in Spark."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        places = common.worker_store("knn_places", _Places)
        df, n = np.zeros(PLACES, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                df[term_counts(text.as_py() or "", places)[0]] += 1
            n += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["place", "df"])

    rows = common.map_arrow(docs.select("text"), run, "place long, df long", "knn_places").groupBy("place").agg(F.sum("df").alias("df")).collect()  # at most PLACES + 1
    df, n = np.zeros(PLACES), 0
    for r in rows:
        if r["place"] < 0:
            n = r["df"]
        else:
            df[r["place"]] = r["df"]
    return np.log((n + 1) / (df + 1)) + 0.1


def latent_space(multiply, rank: int = RANK):
    """Right singular vectors (PLACES x rank) of a matrix W by subspace iteration; multiply(basis) is W' W basis."""
    import numpy as np

    basis = np.random.default_rng(7).standard_normal((PLACES, rank + 8))
    for _ in range(ROUNDS):
        basis = np.linalg.qr(multiply(basis.astype(np.float32)))[0]
    # the strongest directions inside the subspace come first
    values, turn = np.linalg.eigh(basis.T @ multiply(basis.astype(np.float32)))
    return np.ascontiguousarray((basis @ turn[:, ::-1])[:, :rank], dtype=np.float32)


@dataclass
class Voters:
    idf: object
    space: object
    vectors: object
    labels: object
    prior: float

    def project(self, rows: list):
        import numpy as np

        q = np.stack([w @ self.space[at] for at, w in rows]) if rows else np.zeros((0, self.space.shape[1]), np.float32)
        n = np.sqrt((q * q).sum(axis=1, keepdims=True))
        return q / np.where(n > 0, n, 1)

    def vote(self, rows: list):
        """The similarity-weighted share of label 1 among the nearest labelled vectors."""
        import numpy as np

        if not len(self.labels):
            return np.full(len(rows), self.prior)
        near = self.project(rows) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        above, tied = near > last[:, None], near == last[:, None]
        weight = np.where(above, np.maximum(near, 0), 0).astype(float)
        rest = (k - above.sum(axis=1)) * np.maximum(last, 0).astype(float)
        total = weight.sum(axis=1) + rest
        good = weight @ self.labels + rest * (tied @ self.labels) / tied.sum(axis=1)
        return np.where(total > 0, good / np.where(total > 0, total, 1), self.prior)


@common.scratch()
def fit(docs: DataFrame, sample: DataFrame) -> Voters:
    """The space and the labelled vectors of a bounded sample; its term rows stay in a written table, the driver gets products."""
    import numpy as np

    idf = inverse_frequencies(docs)

    def terms(batches: Iterator) -> Iterator:
        import pyarrow as pa

        places = common.worker_store("knn_places", _Places)
        for batch in batches:
            made = [term_counts(t.as_py(), places) for t in batch.column("text")]
            at, w = [a.astype(np.int32) for a, _ in made], [weighted(a, c, idf) for a, c in made]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(at, pa.list_(pa.int32())), pa.array(w, pa.list_(pa.float32()))], ["doc_id", "y", "at", "w"])

    rows = common.map_arrow(sample, terms, "doc_id long, y int, at array<int>, w array<float>", "knn_places")
    rows = common.materialize(rows.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "y", F.xxhash64("at", "w")), "labelled_terms")

    def parts(batches: Iterator) -> Iterator:
        for batch in batches:
            for at, w in zip(batch.column("at"), batch.column("w"), strict=True):
                yield at.values.to_numpy(), w.values.to_numpy()

    def multiply(basis):
        known = rows.sparkSession.sparkContext.broadcast(basis)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            out = np.zeros(known.value.shape, dtype=np.float32)
            for at, w in parts(batches):
                out[at] += w[:, None] * (w @ known.value[at])
            yield pa.RecordBatch.from_pydict({"part": pa.array([out.tobytes()], pa.binary())})

        total = np.zeros(basis.shape)
        for r in common.map_arrow(rows.select("at", "w").coalesce(PARTS), run, "part binary").toLocalIterator():
            total += np.frombuffer(r["part"], dtype=np.float32).reshape(basis.shape)
        known.destroy()
        return total

    voters = Voters(idf, latent_space(multiply), np.zeros((0, RANK), np.float32), np.zeros(0), 0.0)
    known = rows.sparkSession.sparkContext.broadcast(voters.space)

    def projected(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            vectors = [w @ known.value[at] for at, w in parts([batch])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([v.tobytes() for v in vectors], pa.binary())], ["doc_id", "y", "vector"])

    got = common.map_arrow(rows, projected, "doc_id long, y int, vector binary").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("vector", "ascending")])
    if got.num_rows:
        q = np.stack([np.frombuffer(v.as_py(), dtype=np.float32) for v in got.column("vector")])
        n = np.sqrt((q * q).sum(axis=1, keepdims=True))
        voters.vectors, voters.labels = q / np.where(n > 0, n, 1), got.column("y").to_numpy().astype(float)
        voters.prior = float(voters.labels.mean())
    return voters


def score_documents(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id and score of every row of docs."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    known = spark.sparkContext.broadcast(voters)  # MOST_LABELLED x RANK and PLACES x RANK floats at most

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        places, v = common.worker_store("knn_places", _Places), known.value
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, BLOCK):
                made = [term_counts(t.as_py() or "", places) for t in batch.column("text").slice(k, BLOCK)]
                out.append(v.vote([(at, weighted(at, n, v.idf)) for at, n in made]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return common.map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double", "knn_places")


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    voters = fit(docs, labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), 5) != 0, MOST_LABELLED))
    scored = score_documents(docs, voters)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
