"""Substring deduplication over sliding spans of sentences.

From every sentence of a text a span starts, and at every sentence one ends: the fewest consecutive
sentences, MIN_SENTENCES or more, that have MIN_WORDS words together. Where it ends (or starts)
depends only on what follows (or comes before), so a passage that documents share gives the same
spans in each, up to its last sentence. A text that is too short for such a span is one span as a
whole, so equal short texts are found too. Spans (lower-cased, runs of white
space as one space) are hashed and joined globally; sentences covered by a span that is not the
first of its kind, in the order (doc_id, place), are removed. Sentences end after . ! ? and white
space, at a line's end, and after the words whose hash says so, one in CUT_WORDS: where a passage is
cut inside depends on its own words alone, so it is cut alike amid any other text and in run-on text
too. What is kept stays as it was, character by character.

Spans that repeat inside a text are found while it is read, so the global step has one row for each
span and document. Its aggregate keeps the least doc_id of each hash, combined before the shuffle;
the rows of repeated hashes are then picked by a filter and joined exactly, very common ones in
salted parts.

Defined cases: a null text stays null with no sentence, and one without a word has no span; a null
doc_id comes first in the order; rows that repeat a doc_id count as one document, whether their texts
are equal or not: none loses a span to the other, and all lose what an earlier document has; an empty table gives an empty result; other columns pass unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, compress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.llm import common

MIN_SENTENCES, MIN_WORDS, CUT_WORDS = 2, 16, 12
#: Words that a worker remembers.
CACHE_WORDS = 400_000
#: What workers keep from task to task.
STORES = ("sentence_ends", "sentence_words")


class _Ends(dict):
    """For a word with the white space after it: whether a sentence ends there."""

    def __missing__(self, token: str) -> bool:
        import zlib

        word = token.strip()
        after = token[len(word) :]
        ends = "\n" in after or (after != "" and word[-1] in ".!?") or zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % CUT_WORDS == 0
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[token] = ends
        return ends


class _Low(dict):
    """For a word with the white space after it: the word in lower case."""

    def __missing__(self, token: str) -> str:
        low = token.strip().lower()
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[token] = low
        return low


_TOKEN = re.compile(r"\S+\s*")


def _tokens(text: str) -> tuple[list[str], list[int]]:
    """The words of a text with the white space after each, and after how many words each sentence ends."""
    tokens = _TOKEN.findall(text)
    n = len(tokens)
    cuts = list(compress(range(1, n + 1), map(common.worker_store("sentence_ends", _Ends).__getitem__, tokens)))
    if n and cuts[-1:] != [n]:
        cuts.append(n)
    return tokens, cuts


def _starts(text: str, tokens: list[str], cuts: list[int]) -> list[int]:
    """Where sentences start, closed by the text's length; a text without a word has its length only."""
    if not tokens:
        return [len(text)]
    at = list(accumulate(map(len, tokens), initial=len(text) - sum(map(len, tokens))))
    return [0, *map(at.__getitem__, cuts)]


def sentences(text: str) -> tuple[list[int], list[list[str]]]:
    """Where sentences start, closed by the text's length, and their lower-cased words. Each has a word; text without any has no sentence."""
    tokens, cuts = _tokens(text)
    return _starts(text, tokens, cuts), _words(tokens, cuts)


def _words(tokens: list[str], cuts: list[int]) -> list[list[str]]:
    low = list(map(common.worker_store("sentence_words", _Low).__getitem__, tokens))
    return [low[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def n_sentences(text: str) -> int:
    return len(_tokens(text)[1])


def spans(words: list[list[str]], min_sentences: int, min_words: int) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, digest) of every span."""
    from xxhash import xxh3_128_digest

    digests = [xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words]
    n, sizes = len(words), [len(w) for w in words]
    found, j, held = set(), 0, 0
    for i in range(n):  # from sentence i on
        while j < n and (held < min_words or j - i < min_sentences):
            held += sizes[j]
            j += 1
        if held < min_words or j - i < min_sentences:
            break
        found.add((i, j))
        held -= sizes[i]
    i, held = 0, 0
    for j in range(1, n + 1):  # up to sentence j
        held += sizes[j - 1]
        while held - sizes[i] >= min_words and j - i > min_sentences:
            held -= sizes[i]
            i += 1
        if held >= min_words and j - i >= min_sentences:
            found.add((i, j))
    if n and not found:
        found.add((0, n))
    return [(i, j - i, xxh3_128_digest(b"".join(digests[i:j]))) for i, j in sorted(found)]


def span_table(keyed: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """A row for each span: document, place, digest, and whether its text has it earlier."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def made(batch, row, at, size, digests, again):
            h = np.frombuffer(b"".join(digests), dtype=np.dtype([("h1", "<i8"), ("h2", "<i4"), ("x", "<i4")]))
            take = pa.array(row, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column("_doc").take(take), batch.column("_dig").take(take), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(h["h1"].copy()), pa.array(h["h2"].copy()), pa.array(again, pa.bool_())],
                ["doc", "dig", "at", "size", "h1", "h2", "again"],
            )

        for batch in batches:
            row, at, size, digests, again = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                seen: set[bytes] = set()
                for a, n, d in spans(_words(*_tokens(text.as_py() or "")), min_sentences, min_words):
                    row.append(i)
                    at.append(a)
                    size.append(n)
                    digests.append(d)
                    again.append(d in seen)
                    seen.add(d)
                if len(row) > 50_000:
                    yield made(batch, row, at, size, digests, again)
                    row, at, size, digests, again = [], [], [], [], []
            yield made(batch, row, at, size, digests, again)

    return common.map_arrow(keyed.select("_doc", "_dig", "text"), run, f"doc {common.doc_type(keyed)}, dig long, at int, size int, h1 long, h2 int, again boolean", *STORES)


def _picked(table: DataFrame, hot, bits=None) -> DataFrame:
    """The rows whose h1 passes the filter `bits` (all without one), with _maybe: whether it passes `hot`."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        common_one, test = common.key_test(hot.value), bits and common.key_test(bits.value)
        for batch in batches:
            if test:
                batch = batch.filter(pa.array(test(batch.column("h1").to_numpy())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(common_one(batch.column("h1").to_numpy()))], [*batch.schema.names, "_maybe"])

    return common.map_arrow(table, run, common.ddl(table) + ", _maybe boolean")


def covered(keyed: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """(_doc, _dig, gone array<struct<at, size>>): the spans to remove, for documents that lose any."""
    table = common.materialize(span_table(keyed, min_sentences, min_words), "spans")
    firsts = table.filter("not again")
    repeated = firsts.groupBy("h1", "h2").agg(F.min("doc").alias("lead"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("copies")).filter("lead != last").drop("last")
    repeated = common.materialize(repeated, "repeated_spans")
    sc, very = keyed.sparkSession.sparkContext, F.col("copies") >= common.HOT_ROWS
    bits, hot = (sc.broadcast(common.key_bits(k, F.col("h1"))) for k in (repeated, repeated.filter(very)))
    rows = _picked(firsts.select("doc", "dig", "at", "size", "h1", "h2"), hot, bits)
    later = common.meet_marked(rows, _picked(repeated.drop("copies"), hot), ["h1", "h2"], "doc", "dig").filter("doc != lead")
    gone = later.select("doc", "dig", "at", "size").unionByName(table.filter("again").select("doc", "dig", "at", "size"))
    return gone.groupBy(F.col("doc").alias("_doc"), F.col("dig").alias("_dig")).agg(F.collect_set(F.struct("at", "size")).alias("gone"))


@common.scratch("gone_spans")
def remove_repeats(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the sentences that stay as text, and n_sentences and n_removed (of the text as it was)."""
    keyed = common.keyed(docs)
    gone = common.materialize(covered(keyed, min_sentences, min_words), "gone_spans")
    joined = common.with_few(keyed, gone, ["_doc", "_dig"]).select("row", "gone")
    own = ("n_sentences", "n_removed")
    out = [c for c in docs.columns if c not in own]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            row, texts, total, lost = batch.column("row"), [], [], []
            columns = {c: row.field(c) for c in out}
            for text, gone in zip(columns["text"], batch.column("gone"), strict=True):
                text, gone = text.as_py(), gone.as_py()
                drop = {k for g in gone or () for k in range(g["at"], g["at"] + g["size"])}
                tokens, cuts = _tokens(text or "")
                total.append(len(cuts))
                lost.append(len(drop))
                if drop:
                    starts = _starts(text, tokens, cuts)
                    text = "".join(text[starts[k] : starts[k + 1]] for k in range(total[-1]) if k not in drop)
                texts.append(text)
            columns["text"] = pa.array(texts, columns["text"].type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(total, pa.int64()), pa.array(lost, pa.int64())], [*out, *own])

    return common.map_arrow(joined, run, common.ddl(docs, *own) + ", n_sentences long, n_removed long", *STORES)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("has_repeats"), "text")
