"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

A document longer than a sequence is cut into full pieces and a rest; no other one is cut.
Lengths are at most `capacity`, so how many pieces have each length says all that packing needs:
the driver packs that histogram (at most `capacity` numbers, whatever the corpus) and what it
returns are bin patterns with a multiplicity. Pieces find their place by their rank among those
of the same length, which is counted per (length, hash bucket), as many buckets as the length needs.

Best-two-fit: a bin is filled greedily, the longest piece that fits first. If a gap remains, its
smallest piece s gives way to the two unpacked pieces whose sum is the largest that is above s
and within gap + s, as long as such a pair exists.

Defined cases: a null text counts as empty; an empty text is the end token alone; a null doc_id is
kept as null; repeated rows are packed once each; an empty table gives an empty result; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mojiweave.llm import common

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers; the memory starts anew when it is full.
CACHE_WORDS = 600_000
#: A length's pieces are dealt into BUCKETS of this many on average at least; what goes beyond fills them up to BUCKET_MOST before there are more.
BUCKET_ROWS, BUCKET_MOST, BUCKETS = 250, 100_000, 4096

# --- fixed values: how the vocabulary that WordEncoder knows cuts texts into words, as its file says ---
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_CUTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordEncoder:
    """Ids of a text as little-endian 32-bit bytes, the same as the tokenizer gives.

    A word vocabulary's pre-tokens are encoded independently, so their ids are remembered. That
    path is taken if the file cuts texts as WORD_NORMALIZER and WORD_CUTS say, for texts of
    characters whose case folding, normal form and class leave no doubt; any other text, and any
    text under another kind of file, goes through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        import numpy as np

        self._np, self._tokenizer = np, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # an added token is cut out before words are; texts that may hold one are told by these signs
        self._by_word = spec["normalizer"] == WORD_NORMALIZER and spec["pre_tokenizer"] == WORD_CUTS and spec["post_processor"] is None and all("<|" in x["content"] for x in spec["added_tokens"])
        letters = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
        self._plain = re.compile(rf"[\t\n\r\x20-\x7e{letters}]*").fullmatch
        self._words = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[0-9]|[^\s{letters}0-9]+").findall
        self._known: dict[str, bytes] = {}

    def _slow(self, text: str) -> bytes:
        return self._np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not self._by_word or "<|" in text or not self._plain(text):
            return self._slow(text)
        words, known = self._words(text.lower()), self._known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            missing = list({w for w in words if w not in known})
            if len(known) + len(missing) > CACHE_WORDS:
                known.clear()
                missing = list(set(words))
            for w, e in zip(missing, self._tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                known[w] = self._np.asarray(e.ids, dtype="<u4").tobytes()
            return b"".join(map(known.__getitem__, words))


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if kept, ids."""
    path = tokenizer or default_tokenizer()
    store = f"words_{zlib.crc32(path.encode())}"
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = PIECES.replace("doc_id long", f"doc_id {kind}") + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = common.worker_store(store, lambda: WordEncoder(path))
        end = np.asarray([end_id], dtype="<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                data = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            out = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return common.map_arrow(docs.select("doc_id", "text"), run, schema, store)


def best_two_fit(counts, capacity: int):
    """Bin patterns for a histogram (counts[l] pieces of length l).

    Returns (segments, bins): segments are rows (length, first rank, copies in a bin, first bin,
    offset, bins); a pattern's bins are numbered consecutively.
    """
    import numpy as np

    counts = np.asarray(counts, dtype=np.int64).copy()
    taken = np.zeros(capacity + 1, dtype=np.int64)
    segments, bins = [], 0
    lengths = np.flatnonzero(counts)
    while len(lengths):
        used: dict[int, int] = {}
        gap = capacity
        top = len(lengths)
        while gap and (top := int(np.searchsorted(lengths[:top], gap, "right"))):
            top -= 1
            size = int(lengths[top])
            n = min(int(counts[size]), gap // size)
            used[size] = n
            gap -= n * size
        while gap:
            small = min(used)
            room = gap + small
            free = counts[lengths]
            for size, n in used.items():
                free[np.searchsorted(lengths, size)] -= n
            open_ = lengths[(free > 0) & (lengths < room)]
            left = free[(free > 0) & (lengths < room)]
            if not len(open_):
                break
            other = np.searchsorted(open_, room - open_, "right") - 1
            other = np.minimum(other, np.arange(len(open_)))  # the second is the shorter one
            alone = (other == np.arange(len(open_))) & (left < 2)
            other = other - alone
            total = np.where(other >= 0, open_ + open_[np.maximum(other, 0)], -1)
            at = len(total) - 1 - int(np.argmax(total[::-1]))
            if total[at] <= small:
                break
            used[small] -= 1
            if not used[small]:
                del used[small]
            for size in (int(open_[at]), int(open_[other[at]])):
                used[size] = used.get(size, 0) + 1
            gap = room - int(total[at])
        times = min(int(counts[size]) // n for size, n in used.items())
        offset = 0
        for size in sorted(used, reverse=True):
            n = used[size]
            segments.append((size, int(taken[size]), n, bins, offset, times))
            taken[size] += times * n
            counts[size] -= times * n
            offset += n * size
        bins += times
        lengths = lengths[counts[lengths] > 0]
    return segments, bins


def bucket_count(n: int) -> int:
    """Into how many buckets n pieces of one length are dealt."""
    return 1 + n // max(BUCKET_ROWS, min(BUCKET_MOST, n // BUCKETS))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece, length, ids_crc32) with sequence_id and offset added. pieces must be a written table."""
    histogram = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = [0] * (capacity + 1)
    for r in histogram:
        counts[r["length"]] = r["count"]
    segments, _ = best_two_fit(counts, capacity)
    dealt = pieces.sparkSession.createDataFrame([(r["length"], bucket_count(r["count"])) for r in histogram], "length int, _buckets long")  # at most `capacity` rows
    rows = pieces.join(F.broadcast(dealt), "length").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "_buckets")).drop("_buckets")
    per = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(local) - 1).join(per, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_bucket", "_base")
    names = [c for c in pieces.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        s = np.asarray(sorted(segments), dtype=np.int64).reshape(-1, 6)
        keys = (s[:, 0] << 44) | s[:, 1]
        for batch in batches:
            size = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy().astype(np.int64)
            at = np.searchsorted(keys, (size << 44) | rank, "right") - 1
            rest = rank - s[at, 1]
            sequence = s[at, 3] + rest // np.maximum(s[at, 2], 1)
            offset = s[at, 4] + rest % np.maximum(s[at, 2], 1) * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return common.map_arrow(ranked.select(*names, "_rank"), run, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Every piece with its place; with keep_ids also its token ids."""
    return place(common.materialize(tokenize_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids and the lengths of their documents' pieces. Bounded by the capacity."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: F.size(x["ids"])).alias("lengths"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack_documents(common.table(spark, sf_dir, "documents"), keep_ids=False)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
