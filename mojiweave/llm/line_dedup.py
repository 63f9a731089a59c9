"""Line deduplication with an edit bound of one character, by a deletion-neighbourhood join.

A line (lower-cased, runs of white space as one space) goes if an earlier line, in the order
(doc_id, text digest, line number), is within the edit bound of it. The bound is a tenth of the
line's length, one at most: nothing below MIN_CHARS characters, so equal lines go whatever their length, and from
there on one character inserted, deleted or replaced, which in a shorter line often makes another
word. Every occurrence of a line that goes for a near line goes.

Equal lines are counted once, by a 128-bit digest. For the rest, the neighbourhood is joined thrice:
1. coarse: a line without one of its four blocks is a key. Two lines one edit apart share the key
   of the block that holds the edit, so lines whose keys are all their own have no near line.
2. middle: of the lines that are left, the same with the eighths of the blocks that matched.
3. fine: of what is left, and only inside the eighths that matched, all variants with one
   character deleted are keys. Lines with equal variant and place differ in that character alone;
   a line equal to another's variant lacks one character. In either group the earliest line is the
   one that stays, found by an aggregate, so no pairs are listed. The edit to it is verified on
   the texts at the place it was found, in time linear in their length. A group has no more lines
   than there are characters to put in one place, so none is hot.

Defined cases: a null text stays null with no line; lines without a word always stay; a null doc_id comes
first in the order; rows that repeat a doc_id and its text are one document and lose the same lines;
an empty table gives an empty result; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.llm import common

#: Least length of two lines that are compared for one edit, and of lines that go as exact repeats.
MIN_CHARS, EXACT_CHARS = 10, 1
#: Share of a document's characters that must be left by drop_repeated_lines() for it to stay.
LEAST_LEFT = (1, 2)
#: What normal() takes as white space.
_BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_CLASS, _BLOCKS, _PARTS = 8, 4, 8


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def coarse_spans(n: int) -> list[tuple[int, int, int]]:
    """(seed, characters kept at the start, at the end) of each coarse key of a line of n characters.

    Lengths share a class of _CLASS; the longest of a class also has the keys of the next one, for
    the line that has one character more.
    """
    out = []
    for c in [n // _CLASS] + [n // _CLASS + 1] * (n % _CLASS == _CLASS - 1):
        least = c * _CLASS
        step = least // _BLOCKS
        out += [(c * _BLOCKS + j, j * step, max(0, least - (j + 1) * step)) for j in range(_BLOCKS)]
    return out


def part_spans(n: int, k: int) -> list[tuple[int, int, int]]:
    """The same for the parts of the k-th coarse key: only what that key left out is divided."""
    seed, a, b = coarse_spans(n)[k]
    c, j = divmod(seed, _BLOCKS)
    least = c * _CLASS
    step = -(-(least // _BLOCKS) // _PARTS)
    return [(seed * _PARTS + i, min(a + i * step, n), b if i == _PARTS - 1 else max(b, least - a - (i + 1) * step)) for i in range(_PARTS)]


class Hashes:
    """Hashes of lines, and of lines without one character, from sums over prefixes: constant time for each.

    Two polynomials over mixed characters, one modulo 2**64 and one modulo a prime, are mixed into
    64 bits: equal texts have equal hashes, whichever line they were cut from.
    """

    BASE, PRIME, BASE2 = 0x9E3779B97F4A7C15, 2**31 - 1, 48271
    BACK, BACK2 = pow(BASE, -1, 1 << 64), pow(BASE2, -1, PRIME)

    def __init__(self, lines: list[str]):
        import numpy as np

        c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        size = np.asarray([len(x) for x in lines], dtype=np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        at = np.arange(len(c)) - np.repeat(self.start, size)
        most = int(size.max(initial=0))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(c + np.uint64(1)) * self._powers(most)[at])])
        self._sums2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * self._powers2(most)[at] % np.uint64(self.PRIME))])

    def _powers(self, n: int):
        import numpy as np

        out = np.full(n, self.BASE, dtype=np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    def _powers2(self, n: int):
        import numpy as np

        out = np.ones(1, dtype=np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(self.BASE2, len(out), self.PRIME)) % np.uint64(self.PRIME)])
        return out[:n]

    def whole(self, rows):
        a, b = self.start[rows], self.end[rows]
        return self._joined(self._sums[b] - self._sums[a], (self._sums2[b] - self._sums2[a]) % self.PRIME)

    def without(self, rows, at):
        """The hashes of the lines `rows` without their characters at `at`."""
        import numpy as np

        a, b = self.start[rows], self.end[rows]
        p, prime = a + at, np.uint64(self.PRIME)
        one = self._sums[p] - self._sums[a] + (self._sums[b] - self._sums[p + 1]) * np.uint64(self.BACK)
        two = self._sums2[p] - self._sums2[a] + (self._sums2[b] - self._sums2[p + 1]) % prime * np.uint64(self.BACK2) % prime
        return self._joined(one, two % prime)

    @staticmethod
    def _joined(one, two):
        import numpy as np

        return _mix(one + _mix(two + np.uint64(1))).view(np.int64)


def _mix(x):
    """The splitmix64 finaliser."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def line_table(keyed: DataFrame, min_chars: int, exact_chars: int) -> DataFrame:
    """A row for each line that counts: its place, its 128-bit digest and its coarse keys (none under min_chars)."""
    least = max(1, min(min_chars, exact_chars))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        def made(batch, row, no, digests, keys, sizes):
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            at = pa.array(row, pa.int64())
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.asarray(keys, dtype=np.uint64).view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column("_doc").take(at), batch.column("_dig").take(at), pa.array(no, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), lists], ["doc", "dig", "no", "h1", "h2", "keys"])

        for batch in batches:
            row, no, digests, keys, sizes = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                for k, line in enumerate((text.as_py() or "").split("\n")):
                    line = normal(line)
                    n = len(line)
                    if n < least:
                        continue
                    row.append(i)
                    no.append(k)
                    digests.append(xxh3_128_digest(line.encode("utf-8", "surrogatepass")))
                    spans = coarse_spans(n) if n >= min_chars else []
                    sizes.append(len(spans))
                    keys += [xxh3_64_intdigest((line[:a] + "\0" + line[n - b :]).encode("utf-8", "surrogatepass"), seed) for seed, a, b in spans]
                if len(row) > 50_000:
                    yield made(batch, row, no, digests, keys, sizes)
                    row, no, digests, keys, sizes = [], [], [], [], []
            yield made(batch, row, no, digests, keys, sizes)

    return common.map_arrow(keyed.select("_doc", "_dig", "text"), run, f"doc {common.doc_type(keyed)}, dig long, no int, h1 long, h2 long, keys array<long>")


def _texts(keyed: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """wanted (h1, h2, ...) with the lines' texts, from a second reading; a filter lets few others pass."""
    bits = keyed.sparkSession.sparkContext.broadcast(common.key_bits(wanted, F.col("h1")))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        test = common.key_test(bits.value)
        for batch in batches:
            found: dict[bytes, str] = {}
            for text in batch.column("text"):
                for line in (text.as_py() or "").split("\n"):
                    if len(line := normal(line)) >= min_chars:
                        found[xxh3_128_digest(line.encode("utf-8", "surrogatepass"))] = line
            h = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            good = test(h[:, 0]) if len(h) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(list(found.values()), pa.string())], ["h1", "h2", "line"]).filter(pa.array(good, pa.bool_()))

    return common.map_arrow(keyed.select("text"), run, "h1 long, h2 long, line string").dropDuplicates(["h1", "h2"]).join(wanted, ["h1", "h2"])


def _part_keys(lines: DataFrame) -> DataFrame:
    """The keys of the parts of each line's matched blocks; part numbers both, block * _PARTS + part."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            row, part, key = [], [], []
            for i, (line, blocks) in enumerate(zip(batch.column("line"), batch.column("blocks"), strict=True)):
                line = line.as_py()
                n = len(line)
                for k in blocks.as_py():
                    for p, (seed, a, b) in enumerate(part_spans(n, k)):
                        row.append(i)
                        part.append(k * _PARTS + p)
                        key.append(xxh3_64_intdigest((line[:a] + "\0" + line[n - b :]).encode("utf-8", "surrogatepass"), seed))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("h1").take(take), batch.column("h2").take(take), pa.array(part, pa.int32()), pa.array(np.asarray(key, dtype=np.uint64).view(np.int64))], ["h1", "h2", "part", "key"])

    return common.map_arrow(lines.select("line", "blocks", "h1", "h2"), run, "h1 long, h2 long, part int, key long")


def _shared(keys: DataFrame, what: str, name: str) -> DataFrame:
    """(h1, h2, name) of the lines with a key that another line has too; name: which of the line's keys."""
    shared = keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a != b").select("key")
    return keys.join(shared, "key").groupBy("h1", "h2").agg(F.collect_set(what).alias(name))  # no more than a line has keys


def _variants(lines: DataFrame) -> DataFrame:
    """Each line itself (at = -1) and with one character deleted at each place inside its matched parts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lines = batch.column("line").to_pylist()
            row, at = [np.arange(len(lines))], [np.full(len(lines), -1)]
            for i, (line, parts) in enumerate(zip(lines, batch.column("parts").to_pylist(), strict=True)):
                n, places = len(line), []
                for x in parts:
                    _, a, b = part_spans(n, x // _PARTS)[x % _PARTS]
                    places.append(np.arange(a, max(a, n - b)))
                at.append(np.unique(np.concatenate(places)))
                row.append(np.full(len(at[-1]), i))
            hashes = Hashes(lines)
            row, at = np.concatenate(row), np.concatenate(at)
            for k in range(0, len(row), 100_000):
                r, p = row[k : k + 100_000], at[k : k + 100_000]
                v = np.where(p < 0, hashes.whole(r), hashes.without(r, np.maximum(p, 0)))
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(p.astype(np.int32)), *(batch.column(c).take(take) for c in ("h1", "h2", "first"))], ["v", "at", "h1", "h2", "first"])

    first = lines.schema["first"].dataType.simpleString()
    return common.map_arrow(lines.select("line", "parts", "h1", "h2", "first"), run, f"v long, at int, h1 long, h2 long, first {first}")


def near_lines(keyed: DataFrame, lines: DataFrame, unique: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2) of the lines that have an earlier line one edit away. unique: (h1, h2, first, keys)."""
    keys = unique.select("h1", "h2", F.posexplode("keys").alias("block", "key"))
    near = _shared(keys, "block", "blocks").join(unique.select("h1", "h2", "first"), ["h1", "h2"])
    texts = common.materialize(_texts(keyed, common.materialize(near, "near_blocks"), min_chars), "near_texts")
    parts = _shared(_part_keys(texts), "part", "parts")
    texts = common.materialize(texts.drop("blocks").join(parts, ["h1", "h2"]), "near_parts")
    variants = common.materialize(_variants(texts), "variants")

    line = F.struct("first", "h1", "h2")
    swaps = variants.filter("at >= 0")
    least = swaps.groupBy("v", "at").agg(F.min(line).alias("lead"), F.max(line).alias("last")).filter("lead != last").drop("last")
    replaced = swaps.join(least, ["v", "at"]).select("h1", "h2", "first", "lead", "at", F.lit("both").alias("cut"))
    whole, part = F.col("at") < 0, F.col("at") >= 0
    both = variants.groupBy("v").agg(F.min(F.when(whole, line)).alias("w"), F.min(F.when(part, F.struct("first", "h1", "h2", "at"))).alias("p")).filter("w is not null and p is not null")
    lead = F.when(whole, F.struct("p.first", "p.h1", "p.h2")).otherwise(F.col("w"))
    longer = variants.join(both, "v").select("h1", "h2", "first", lead.alias("lead"), F.when(whole, F.col("p.at")).otherwise(F.col("at")).alias("at"), F.when(whole, "lead").otherwise("own").alias("cut"))
    pairs = replaced.unionByName(longer).filter(F.col("first") > F.col("lead.first")).groupBy("h1", "h2", F.col("lead.h1").alias("g1"), F.col("lead.h2").alias("g2"), "cut").agg(F.min("at").alias("at"))
    pairs = pairs.join(texts.select("h1", "h2", F.col("line").alias("a")), ["h1", "h2"])
    pairs = pairs.join(texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("b")), ["g1", "g2"])

    def without(x: str) -> Column:
        return F.concat(F.substr(x, F.lit(1), F.col("at")), F.substr(x, F.col("at") + 2, F.length(x)))

    a, b = F.when(F.col("cut") == "lead", F.col("a")).otherwise(without("a")), F.when(F.col("cut") == "own", F.col("b")).otherwise(without("b"))
    return pairs.filter(a == b).select("h1", "h2").distinct()


def removed_lines(keyed: DataFrame, min_chars: int, exact_chars: int) -> DataFrame:
    """(_doc, _dig, gone): the numbers of the lines that go, for documents that lose any."""
    lines = common.materialize(line_table(keyed, min_chars, exact_chars), "lines")
    place = F.struct("doc", "dig", "no")
    unique = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    unique = common.materialize(unique, "unique_lines")
    near = near_lines(keyed, lines, unique, min_chars).withColumn("near", F.lit(True))
    suspects = unique.select("h1", "h2", "first", "last", "copies").join(near, ["h1", "h2"], "left").filter("near or first != last").select("h1", "h2", "first", "near", "copies")
    gone = common.meet(lines.drop("keys"), common.materialize(suspects, "suspects"), ["h1", "h2"], "doc", "no").filter(F.coalesce("near", F.lit(False)) | (place != F.col("first")))
    return gone.groupBy(F.col("doc").alias("_doc"), F.col("dig").alias("_dig")).agg(F.collect_set("no").alias("gone"))


@common.scratch("gone_lines")
def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """docs with the remaining lines as text, and n_lines, n_removed (of the text as it was) and n_removed_chars (without white space).

    min_chars: of lines compared for one edit; exact_chars: of exact repeats.
    """
    keyed = common.keyed(docs)
    gone = common.materialize(removed_lines(keyed, min_chars, exact_chars), "gone_lines")
    joined = common.with_few(keyed, gone, ["_doc", "_dig"]).select("row", "gone")
    own = ("n_lines", "n_removed", "n_removed_chars")
    out = [c for c in docs.columns if c not in own]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            row, gone = batch.column("row"), batch.column("gone")
            columns = {c: row.field(c) for c in out}
            text = columns["text"]
            n = pc.add(pc.count_substring(text, "\n"), pa.scalar(1, pa.int32())).cast(pa.int64()).fill_null(0)
            lost = pc.list_value_length(gone).cast(pa.int64()).fill_null(0)
            kept, chars = [], [0] * batch.num_rows
            for i in pc.indices_nonzero(lost).to_pylist():
                drop, lines = set(gone[i].as_py()), text[i].as_py().split("\n")
                kept.append("\n".join(x for k, x in enumerate(lines) if k not in drop))
                chars[i] = sum(len("".join(lines[k].split())) for k in drop)
            if kept:
                columns["text"] = pc.replace_with_mask(text, pc.greater(lost, 0), pa.array(kept, text.type))
            yield pa.RecordBatch.from_arrays([*columns.values(), n, lost, pa.array(chars, pa.int64())], [*out, *own])

    return common.map_arrow(joined, run, common.ddl(docs, *own) + ", n_lines long, n_removed long, n_removed_chars long")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS, least_left: tuple[int, int] = LEAST_LEFT) -> DataFrame:
    """The rows of docs with their remaining lines; n_chars follows the text.

    A document that lost lines goes if no word is left, or less than least_left (a fraction) of its
    characters without white space: what is left of a copy whose other lines went is a fragment.
    """
    found = dedup_lines(docs, min_chars, exact_chars)
    left, lost = F.length(F.translate("text", _BLANK, "")), F.col("n_removed_chars")
    poor = (F.col("n_removed") > 0) & ((left == 0) | (least_left[1] * left < least_left[0] * (left + lost)))
    found = found.filter(~F.coalesce(poor, F.lit(False)))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", (F.col("n_removed") > 0).alias("has_repeats"), "text")
