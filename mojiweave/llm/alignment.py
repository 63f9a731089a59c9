"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes, by a dictionary of groups.

A text is encoded by tokenizer A (byte-level BPE, with a space before the text) and B (a sentence-piece
model, which adds that space itself). Byte offsets at which tokens of both end cut the tokens into
groups, written `a1,a2|b1`. The links of a group, all pairs of an A and a B token whose bytes overlap,
depend on its ids alone. So texts are never expanded into links:
1. Chunks of texts are encoded. A chunk's groups are interned: it keeps each distinct group once, with the number
   of its documents that hold it, and for each document the numbers of its groups with their frequencies.
2. The groups of all chunks come together; each distinct one is expanded into links once. A pair's
   count is the sum of its groups' documents, less what documents that hold it in more than one
   group count twice, which each chunk has found for its own documents.
3. Counts are summed up for each group and joined back to the chunks by group; a chunk's
   documents are then frequencies times the sums of their groups.
A row that moves is a group of a chunk, never a token or a group of a document. Groups and pairs that very many chunks or groups share are dealt over salted parts.

Both vocabularies merge no letters across a single space between two signs that are no white space (of SAFE: no
doubt about their class), so a text is cut there, and what a short segment gives is remembered.

A text that is null, empty, or that either tokenizer does not give back byte by byte has no
tokens. Rows that repeat a doc_id are documents of their own; a null doc_id is kept; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.llm import common

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of the texts of a chunk, about, and of the texts that are encoded at once; what segments a worker remembers.
CHUNK, STEP, CACHE_CHARS = 4 << 20, 1 << 19, 32 << 20
#: Groups whose links a worker remembers.
CACHE_GROUPS = 100_000
#: Characters before and after a space at which a text may be cut.
SAFE = "!-~À-ÖØ-öø-ɏ"

# --- fixed values: how a vocabulary whose words are cut apart at spaces does it, and says so in its file ---
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_CUTS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)


def byte_alphabet() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokens and groups of texts under two tokenizers; distinct groups and the segments of texts are numbered."""

    def __init__(self, path_a: str, path_b: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self._a.encode_special_tokens = True  # their strings in a text are plain text
        signs, special = byte_alphabet(), {i: t.content for i, t in self._a.get_added_tokens_decoder().items()}
        self.bytes_a = [special[i].encode() if i in special else bytes(signs[c] for c in self._a.id_to_token(i)) for i in range(self._a.get_vocab_size())]
        self.bytes_b = [self._piece(i) for i in range(self._b.get_piece_size())]
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self._sizes = [np.asarray(x, dtype=np.int64) for x in (self.size_a, self.size_b)]
        # texts are cut at spaces only if neither goes across one: B has no such piece, and A cuts words apart before it merges
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        apart = spec["normalizer"] is None and spec["pre_tokenizer"] == WORD_CUTS and not any(re.search("[^▁]▁", self._b.id_to_piece(i)) for i in range(self._b.get_piece_size()))
        self._cut = re.compile(rf"(?<=[{SAFE}]) (?=[{SAFE}])").split if apart else lambda text: [text]
        self._plain = re.compile(f"[{SAFE}]+").fullmatch
        # if ids follow the order of merges, merging by rank is the same, and a faster encoder of ranks does plain segments
        merged = ("".join(x) if isinstance(x, list) else x.replace(" ", "") for x in spec["model"]["merges"])
        vocab = spec["model"]["vocab"]
        self._ranks = None
        if apart and [vocab[x] for x in merged] == list(range(256, len(vocab))):
            self._ranks = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a) if i not in special}, special_tokens={})
        self._links: dict[str, list[tuple[int, int, int]]] = {}
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        #: Numbers of segments and groups; a group is told by its ids.
        self._known: dict[str, int] = {}
        self._number: dict[tuple | int, int] = {}
        #: Text of each group; groups and tokens of each segment (tokens -1: its bytes do not come back), and its groups as a text.
        self.names: list[str] = []
        self._lines: list[str] = []
        self._held, self._new, self._chars = [np.zeros(0, np.int64)] * 4, [], 0

    def _piece(self, i: int) -> bytes:
        if self._b.is_byte(i):
            return bytes([int(self._b.id_to_piece(i)[3:5], 16)])
        return self._b.id_to_piece(i).replace("▁", " ").encode("utf-8", "surrogatepass")

    def _numbered(self, a, b, i: int, x: int, j: int, y: int) -> int:
        """The number of the group of a[i:x] and b[j:y]."""
        left, right = a[i:x].tolist(), b[j:y].tolist()
        key = left[0] << 20 | right[0] if len(left) == len(right) == 1 else (*left, -1, *right)
        if (found := self._number.get(key)) is None:
            found = self._number[key] = len(self.names)
            self.names.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
        return found

    def _learn(self, segments: list[str], flat: list, counts: list) -> None:
        """Numbers segments whose ids of A and of B follow each other in flat. counts: tokens of A, of B, and bytes of each."""
        import numpy as np

        a, b = (np.asarray(x, dtype=np.int64) for x in flat)
        end_a, end_b = (np.cumsum(size[x]) for size, x in zip(self._sizes, (a, b), strict=True))
        ends = end_a[np.isin(end_a, end_b, assume_unique=True)]  # bytes at which tokens of both end
        to_a, to_b = np.searchsorted(end_a, ends) + 1, np.searchsorted(end_b, ends) + 1
        from_a, from_b = np.append(0, to_a)[:-1], np.append(0, to_b)[:-1]
        single = (to_a - from_a == 1) & (to_b - from_b == 1)
        group = np.zeros(len(ends), dtype=np.int64)
        _, first, back = np.unique(a[from_a[single]] << 20 | b[from_b[single]], return_index=True, return_inverse=True)
        at = np.flatnonzero(single)[first]
        group[single] = np.asarray([self._numbered(a, b, *x) for x in zip(from_a[at].tolist(), to_a[at].tolist(), from_b[at].tolist(), to_b[at].tolist(), strict=True)], dtype=np.int64)[back]
        at = np.flatnonzero(~single)
        group[~single] = [self._numbered(a, b, *x) for x in zip(from_a[at].tolist(), to_a[at].tolist(), from_b[at].tolist(), to_b[at].tolist(), strict=True)]
        cuts = np.searchsorted(ends, np.cumsum(counts[2]), "right")
        names, at = [self.names[g] for g in group.tolist()], [0, *cuts.tolist()]
        for s, i, j in zip(segments, at, at[1:], strict=False):
            self._known[s] = len(self._lines)
            self._lines.append(";".join(names[i:j]))
        self._new.append((np.diff(at), counts[0], counts[1], group))
        self._chars += sum(map(len, segments)) + 12 * len(group)

    def _encode(self, missing: list[str]) -> None:
        import numpy as np

        plain = [s for s in missing if self._plain(s)] if self._ranks else []
        for k in range(0, len(plain), 20_000):
            part = plain[k : k + 20_000]
            text = "".join([" " + s for s in part])
            bytes_of = np.asarray([len(s.encode()) + 1 for s in part])
            a, b = np.asarray(self._ranks.encode_ordinary(text)), np.asarray(self._b.encode(text[1:]))
            end_a, end_b = np.cumsum(self._sizes[0][a]), np.cumsum(self._sizes[1][b])
            to = np.cumsum(bytes_of)
            self._learn(part, [a, b], [np.diff(np.searchsorted(end_a, to, "right"), prepend=0), np.diff(np.searchsorted(end_b, to, "right"), prepend=0), bytes_of])
        rest = [s for s in missing if s not in self._known]
        for k in range(0, len(rest), 500):
            part = rest[k : k + 500]
            found = zip(part, [e.ids for e in self._a.encode_batch_fast([" " + s for s in part], add_special_tokens=False)], self._b.encode(part, num_threads=1), strict=True)
            good = []
            for s, x, y in found:
                data = (" " + s).encode()
                if b"".join([self.bytes_a[i] for i in x]) == data == b"".join([self.bytes_b[i] for i in y]):
                    good.append((s, x, y, len(data)))
                else:
                    self._known[s] = len(self._lines)
                    self._lines.append("")
                    self._new.append(([0], [-1], [-1], []))
            if good:
                own, x, y, n = zip(*good, strict=True)
                self._learn(list(own), [[i for z in ids for i in z] for ids in (x, y)], [list(map(len, x)), list(map(len, y)), list(n)])
        self._held = [np.concatenate([np.asarray(z, dtype=np.int64) for z in held]) for held in zip(self._held, *self._new, strict=True)]
        self._new.clear()

    def ready(self) -> None:
        """Forgets what it knows if that is much: between chunks only, as groups are numbered anew."""
        if self._chars > CACHE_CHARS:
            self._forget()

    def __call__(self, texts: list[str]) -> list[tuple | None]:
        """(tokens of A, of B, numbers of the groups in order, groups as a text) of each text; None if it has no tokens."""
        import numpy as np

        cut = [self._cut(t) if t else [] for t in texts]
        known = self._known
        if missing := list({s for c in cut for s in c if s not in known}):
            self._encode(missing)
        sizes, n_a, n_b, group = self._held
        starts, out = np.cumsum(sizes) - sizes, []
        for c in cut:
            ids = [known[s] for s in c]
            at = np.asarray(ids, dtype=np.int64)
            if not ids or (n_a[at] < 0).any():
                out.append(None)
                continue
            n = sizes[at]
            place = np.arange(n.sum()) + np.repeat(starts[at] - (np.cumsum(n) - n), n)
            out.append((int(n_a[at].sum()), int(n_b[at].sum()), group[place], ";".join([self._lines[i] for i in ids])))
        return out

    def links(self, group: str) -> list[tuple[int, int, int]]:
        """(A id, B id, times) of the links of a group."""
        if (found := self._links.get(group)) is None:
            found = self._expanded(group)
            if len(self._links) >= CACHE_GROUPS:
                self._links.clear()
            self._links[group] = found
        return found

    def _expanded(self, group: str) -> list[tuple[int, int, int]]:
        a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
        times: dict[tuple[int, int], int] = {}
        i = j = 0
        x, y = self.size_a[a[0]], self.size_b[b[0]]
        while True:
            times[a[i], b[j]] = times.get((a[i], b[j]), 0) + 1
            if x < y:
                i += 1
                x += self.size_a[a[i]]
            elif y < x:
                j += 1
                y += self.size_b[b[j]]
            else:
                return [(p, q, n) for (p, q), n in times.items()]


class _Chunk:
    """Texts that are interned together."""

    def __init__(self, align: Aligner, keep: bool):
        align.ready()
        self.align, self.keep, self.chars = align, keep, 0
        self.ids, self.docs, self.texts, self.ends, self.groups, self.times = [], [], [], [0], [], []

    def add(self, ids: list, texts: list[str]) -> None:
        import hashlib

        import numpy as np

        self.ids += ids
        self.chars += sum(map(len, texts))
        for found in self.align(texts):
            held, times = np.unique(found[2], return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            self.groups.append(held)
            self.times.append(times)
            self.docs.append((found[0], found[1], len(found[2]), hashlib.sha256(found[3].encode()).hexdigest()) if found else (0, 0, 0, ""))
            self.texts.append(found[3] if found and self.keep else "")
            self.ends.append(self.ends[-1] + len(held))

    def row(self, chunk: int, kind):
        """The chunk as a batch of one row."""
        import numpy as np
        import pyarrow as pa

        own, group = np.unique(np.concatenate([np.zeros(0, np.int64), *self.groups]), return_inverse=True)
        names, ends = [self.align.names[k] for k in own.tolist()], np.asarray(self.ends)
        n_docs = np.bincount(group, minlength=len(names))
        # pairs that a document holds in more than one group: what is too much in the sum over groups
        links = [self.align.links(g) for g in names]
        codes, which = np.unique(np.asarray([a << 32 | b for x in links for a, b, _ in x], dtype=np.int64), return_inverse=True)
        size = np.asarray([len(x) for x in links], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        many = np.zeros(len(codes), dtype=np.int64)
        for at in np.array_split(np.arange(len(ends) - 1), 1 + len(group) // 500_000):  # some documents at a time
            if not len(at):
                continue
            part = slice(ends[at[0]], ends[at[-1] + 1])
            g, d = group[part], doc[part]
            n = size[g]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[g], n)
            held = np.sort(np.repeat(d, n) * max(1, len(codes)) + which[place])
            many += np.bincount(held[1:][held[1:] == held[:-1]] % max(1, len(codes)), minlength=len(codes))
        some = np.flatnonzero(many)

        def one(values, kind):
            values = pa.array(values, kind)
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        columns = {
            "chunk": pa.array([chunk], pa.int64()),
            "doc_id": one(self.ids, kind),
            **{c: one([x[k] for x in self.docs], pa.string() if k == 3 else pa.int64()) for k, c in enumerate(("n_a", "n_b", "n_groups", "sha"))},
            "line": one(self.texts, pa.string()),
            "ends": one(ends[1:], pa.int32()),
            "group": one(group.astype(np.int32), pa.int32()),
            "times": one(np.concatenate([np.zeros(0, np.int64), *self.times]), pa.int32()),
            "name": one(names, pa.string()),
            "n_docs": one(n_docs, pa.int64()),
            "twice_a": one(codes[some] >> 32, pa.int32()),
            "twice_b": one(codes[some] & 0xFFFFFFFF, pa.int32()),
            "twice": one(many[some], pa.int64()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


CHUNKED = "n_a array<long>, n_b array<long>, n_groups array<long>, sha array<string>, line array<string>, ends array<int>, group array<int>, times array<int>, name array<string>, n_docs array<long>, twice_a array<int>, twice_b array<int>, twice array<long>"


def _chunks(docs: DataFrame, paths: tuple[str, str], keep: bool, chars: int) -> DataFrame:
    """A row for each chunk of texts: its documents, its distinct groups, and the pairs that documents hold more than once."""
    store, kind = _store(paths), docs.schema["doc_id"].dataType

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        align = common.worker_store(store, lambda: Aligner(*paths))
        made, chunk, arrow = TaskContext.get().partitionId() << 33, _Chunk(align, keep), None
        for batch in batches:
            arrow = batch.schema.field("doc_id").type
            ids, texts, some, held = batch.column("doc_id").to_pylist(), [], 0, 0
            for k, text in enumerate(batch.column("text"), 1):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= min(STEP, chars) or k == batch.num_rows:
                    chunk.add(ids[some:k], texts)
                    some, texts, held = k, [], 0
                    if chunk.chars >= chars:
                        yield chunk.row(made, arrow)
                        made, chunk = made + 1, _Chunk(align, keep)
        if chunk.ids:
            yield chunk.row(made, arrow)

    return common.map_arrow(docs.select("doc_id", "text"), run, f"chunk long, doc_id array<{kind.simpleString()}>, {CHUNKED}", store)


def _store(paths: tuple[str, str]) -> str:
    return f"aligner_{zlib.crc32(repr(paths).encode())}"


def _held(chunks: DataFrame) -> DataFrame:
    """(chunk, place, name, n_docs, g1, g2) for each group of each chunk; g1, g2 is the group's digest."""
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("name", "n_docs")).alias("place", "x")).select("chunk", "place", "x.name", "x.n_docs")
    return each.withColumn("g1", F.xxhash64("name")).withColumn("g2", F.xxhash64(F.lit(1), "name"))


def _expanded(groups: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(g1, g2, n_docs, a, b, times): the links of each distinct group."""
    store = _store(paths)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        align = common.worker_store(store, lambda: Aligner(*paths))
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                part = batch.slice(k, 20_000)
                found = [align.links(g) for g in part.column("name").to_pylist()]
                take = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                a, b, n = zip(*(y for x in found for y in x), strict=True) if len(take) else ((), (), ())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in ("g1", "g2", "n_docs")), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["g1", "g2", "n_docs", "a", "b", "times"])

    return common.map_arrow(groups.select("g1", "g2", "n_docs", "name"), run, "g1 long, g2 long, n_docs long, a long, b long, times long", store)


def _counts(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, n, top, copies): documents that hold a pair, the most that a pair of its A id has, and groups with the pair; written."""
    twice = chunks.select(F.explode(F.arrays_zip("twice_a", "twice_b", "twice")).alias("x")).select(F.col("x.twice_a").cast("long").alias("a"), F.col("x.twice_b").cast("long").alias("b"), (-F.col("x.twice")).alias("n"), F.lit(0).alias("copies"))
    both = links.select("a", "b", F.col("n_docs").alias("n"), F.lit(1).alias("copies")).unionByName(twice)
    pairs = both.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    # at most as many rows for an id of A as B has ids
    return common.materialize(pairs.join(pairs.groupBy("a").agg(F.max("n").alias("top")), "a"), "pairs")


def _tables(docs: DataFrame, paths: tuple[str, str], keep: bool, chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, links of each distinct group (with copies: chunks that hold it), and counts of pairs."""
    chunks = common.materialize(_chunks(docs, paths, keep, chars), "chunks")
    groups = _held(chunks).groupBy("g1", "g2").agg(F.min("name").alias("name"), F.sum("n_docs").alias("n_docs"))
    links = common.materialize(_expanded(groups, paths), "links")
    return chunks, links, _counts(chunks, links)


@common.scratch("pairs")
def pair_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk_chars: int = CHUNK) -> DataFrame:
    """(a, b, n, top): in how many documents an id of A and one of B are linked, and the most for any pair of that id of A."""
    a, b = default_tokenizers()
    return _tables(docs, (path_a or a, path_b or b), False, chunk_chars)[2].drop("copies")


@common.scratch("chunks", "group_sums")
def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, keep_groups: bool = True, chunk_chars: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs and, if kept, groups: the text `a1,a2|b1;a3|b2`."""
    a, b = default_tokenizers()
    paths = path_a or a, path_b or b
    chunks, links, pairs = _tables(docs, paths, keep_groups, chunk_chars)
    scored = common.meet(links, pairs, ["a", "b"], "g1", "g2")
    sums = scored.groupBy("g1", "g2").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("n_best"))
    held = _held(chunks).select("chunk", "place", "g1", "g2")
    copies = held.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("copies"))
    sums = common.materialize(sums.join(copies, ["g1", "g2"]), "group_sums")
    back = common.meet(held, sums, ["g1", "g2"], "chunk").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", "count_sum", "n_best"))).alias("s"))  # a chunk's own groups
    rows = chunks.drop("name", "n_docs", "twice_a", "twice_b", "twice").join(back, "chunk", "left")
    rows = rows.select("*", F.col("s.count_sum").alias("sums"), F.col("s.n_best").alias("bests")).drop("s", "chunk", *([] if keep_groups else ["line"]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else [])]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                of = {c: batch.column(c)[i].values for c in batch.schema.names}
                group, times = of["group"].to_numpy(), of["times"].to_numpy().astype(np.int64)
                ends = of["ends"].to_numpy()

                def total(sums):
                    if sums is None or not len(group):
                        return np.zeros(len(ends), np.int64)
                    run = np.concatenate([np.zeros(1, np.int64), np.cumsum(sums.to_numpy()[group] * times)])
                    return np.diff(run[np.concatenate([[0], ends])])

                n_a, n_b, n_groups = (of[c].to_numpy() for c in ("n_a", "n_b", "n_groups"))
                # in a group every end but the last belongs to one side, so a link begins at each
                columns = [of["doc_id"], of["n_a"], of["n_b"], of["n_groups"], pa.array(n_a + n_b - n_groups), pa.array(total(of["bests"])), pa.array(total(of["sums"])), of["sha"]]
                yield pa.RecordBatch.from_arrays([*columns, *([of["line"]] if keep_groups else [])], names)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if keep_groups else "")
    return common.map_arrow(rows, run, schema)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"), keep_groups=False)
