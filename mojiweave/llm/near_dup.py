"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round i every shingle is hashed to a bin and a
value; a bin keeps the least (round, value). Rounds go on until every bin of the document is
filled, and from round BINS on round i fills bin i - BINS, so that 2 * BINS rounds always suffice.

Documents with the same shingle set form a class (one node). Bands of coordinates put nodes into
buckets. Then, without ever listing the pairs of a bucket:
1. every node is compared with the least node of each of its buckets, and its best match by sketch
   is verified on full sets; these links give first components.
2. Buckets that still hold nodes of more than one component are dealt out in pairs of blocks of
   about BLOCK nodes. The bucket's largest component has blocks of its own, which meet the others
   but not each other, so what is already connected is read once. In each pair sketches are
   compared across components; nodes of a pair that may link go, with their full sets, to a second
   comparison, which yields a spanning set of verified links.
   A bucket of more than WIDE blocks is first dealt out again: its nodes go to sub-buckets by bands of
   FINE other coordinates each, as many as it takes for a pair just similar enough to share one but
   with NO_BAND at most, so nodes that have only a template in common do not all meet. What is
   still wide after that meets in blocks as above.
A link missed: band width and floor follow from the similarity asked for. At 0.85 (bands of 7) two
sketches share no band with probability 9e-7, at 0.8 (bands of 5) with 2e-9; they fall under the
sketch's floor with 3e-8 at most. Two nodes that meet in wide buckets only share no fine band with
NO_BAND at most in each of them.

Defined cases: a null or wordless text has an empty set, links with nothing and is kept; fewer than
SHINGLE words are one shingle; a row with a null doc_id is kept as it is and links with nothing;
rows that repeat a doc_id are one node that has the links of each, whatever their texts, and all have its component; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.llm import common
from mojiweave.llm.components import connected_components

SHINGLE = 5
#: Similarity from which documents are linked, as a fraction.
ENOUGH = (85, 100)
BINS = 252
#: Probabilities, at most, that a pair just similar enough shares no band, and that it falls under the floor.
NO_BAND, UNDER_FLOOR = 1e-6, 3e-8
BLOCK = 512
#: Blocks from which on a bucket is dealt out again, and coordinates of the bands that do so.
WIDE, FINE = 64, 10
#: Shingles that are sketched at once.
CHUNK = 500_000

_STEP, _MUL1, _MUL2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def band_width(enough: tuple[int, int]) -> int:
    """Coordinates of a band: the most with which a pair just similar enough is missed with NO_BAND at most."""
    s = enough[0] / enough[1]
    return max((w for w in range(1, BINS + 1) if (1 - s**w) ** (BINS // w) <= NO_BAND), default=1)


def floor_of(enough: tuple[int, int]) -> int:
    """Matching coordinates of a pair that is verified: the most under which a pair just similar enough falls with UNDER_FLOOR at most."""
    s, under = enough[0] / enough[1], 0.0
    for k in range(BINS + 1):
        under += math.comb(BINS, k) * s**k * (1 - s) ** (BINS - k)
        if under > UNDER_FLOOR:
            return k
    return BINS


def _mix(x):
    """The splitmix64 finaliser on an array of uint64; x is overwritten."""
    import numpy as np

    x ^= x >> np.uint64(30)
    x *= np.uint64(_MUL1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_MUL2)
    x ^= x >> np.uint64(31)
    return x


def shingle_set(data: bytes, size: int = SHINGLE):
    """The distinct shingles of a UTF-8 text as sorted 64-bit hashes."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = data.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    k = min(n, size)
    total = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total *= np.uint64(_STEP)
        total += h[i : n - k + 1 + i]
        total ^= total >> np.uint64(29)
    return np.unique(_mix(total))


def sketches(sets: list):
    """A row of BINS values for each non-empty set."""
    import numpy as np

    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), BINS), full, dtype=np.uint64)
    flat = out.reshape(-1)
    sizes = np.asarray([len(s) for s in sets], dtype=np.int64)
    x, owner = np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), sizes)
    low, at = np.uint64(0xFFFFFFFF), np.uint64(32)
    for i in range(2 * BINS):
        if not len(x):
            break
        h = _mix(x + np.uint64((i + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        value = (h & low) | np.uint64(i << 32)
        if i < BINS:
            to = (((h >> at) * np.uint64(BINS)) >> at).astype(np.int64)
        else:
            to = i - BINS
        np.minimum.at(flat, owner * BINS + to, value)
        open_ = (out == full).any(axis=1)
        if not open_.all():
            stay = open_[owner]
            x, owner = x[stay], owner[stay]
    return out


def band_keys(table, width: int):
    """Bucket keys of sketches, BINS // width for each."""
    import numpy as np

    n = BINS // width
    parts = table[:, : n * width].reshape(len(table), n, width)
    total = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(width):
        total *= np.uint64(_STEP)
        total += parts[:, :, i]
        total ^= total >> np.uint64(32)
    return _mix(total)


SKETCHED = "n_shingles long, sig_a long, sig_b long, sketch binary, bands array<long>"


def sketch_table(docs: DataFrame, size: int = SHINGLE, enough: tuple[int, int] = ENOUGH) -> DataFrame:
    """doc_id, set size, 128-bit digest of the set, sketch (low bytes) and band keys (none for an empty set)."""
    width = band_width(enough)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        def rows(ids, sets):
            some = [i for i, s in enumerate(sets) if len(s)]
            made = sketches([sets[i] for i in some])
            keys = band_keys(made, width).view(np.int64) if len(some) else np.zeros((0, 1), np.int64)
            low = made.astype(np.uint8)
            sketch, bands = [None] * len(sets), [None] * len(sets)
            for k, i in enumerate(some):
                sketch[i], bands[i] = low[k].tobytes(), keys[k]
            sig = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(sig[:, 0].copy()), pa.array(sig[:, 1].copy()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "sig_a", "sig_b", "sketch", "bands"],
            )

        for batch in batches:
            texts, start, sets, total = batch.column("text").cast(pa.binary()), 0, [], 0
            for i, t in enumerate(texts):
                sets.append(shingle_set(t.as_py() or b"", size))
                total += len(sets[-1])
                if total >= CHUNK:
                    yield rows(batch.column("doc_id").slice(start, len(sets)), sets)
                    start, sets, total = i + 1, [], 0
            if sets:
                yield rows(batch.column("doc_id").slice(start, len(sets)), sets)

    return common.map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, {SKETCHED}")


def _sets_of(docs: DataFrame, nodes: DataFrame, size: int, name: str) -> DataFrame:
    """(node, members) for at least the given nodes: their full sets, from a second reading of the texts.

    A filter lets few others pass; the join with nodes drops those.
    """
    nodes = common.materialize(nodes, f"{name}_nodes")
    bits = docs.sparkSession.sparkContext.broadcast(common.key_bits(nodes, F.xxhash64("node")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        wanted = common.key_test(bits.value)
        for batch in batches:
            batch = batch.filter(pa.array(wanted(batch.column("slot").to_numpy())))
            sets = [shingle_set(t.as_py() or b"", size).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "members"])

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").alias("node"), F.xxhash64("doc_id").alias("slot"), "text")
    return common.materialize(common.map_arrow(rows, run, "node long, members binary").join(nodes, "node", "left_semi"), name)


def _linked(a, b, enough) -> bool:
    """Whether two sorted sets are similar enough; nothing is counted if their sizes rule it out."""
    import numpy as np

    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if enough[1] * len(few) < enough[0] * len(many):
        return False
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    both = int((many[at] == few).sum())
    return enough[1] * both >= enough[0] * (len(a) + len(b) - both)


def _paired(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (a, b; a written table) with the values (node, value) of both as x and y; a node that very many pairs have as b is not one task."""
    copies = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("copies"))
    leads = common.materialize(values.select(F.col("node").alias("b"), F.col("value").alias("y")).join(copies, "b"), "leads")
    return common.meet(pairs.join(values.select(F.col("node").alias("a"), F.col("value").alias("x")), "a"), leads, ["b"], "a").select("a", "b", "x", "y")


def _with_estimate(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """pairs (a, b) with the number of equal sketch coordinates."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((a == b).sum(axis=1).astype(np.int32))], ["a", "b", "equal"])

    return common.map_arrow(_paired(pairs, sketch.select(F.col("doc_id").alias("node"), F.col("sketch").alias("value"))), run, "a long, b long, equal int")


def _verified(pairs: DataFrame, sets: DataFrame, enough) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            good = [_linked(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), enough) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return common.map_arrow(_paired(pairs, sets.withColumnRenamed("members", "value")), run, "a long, b long").distinct()


def _grouped(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """work(group: dict of numpy columns and lists) -> dict of columns, for each group of rows with equal keys (longs).

    The groups are read in a stream from sorted partitions; none is larger than two blocks.
    """
    names = rows.columns

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def parts(table):
            k = np.stack([table.column(c).to_numpy() for c in keys])
            cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            return [0, *cuts.tolist(), table.num_rows]

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            at = parts(t)
            for a, b in zip(at[:-2], at[1:-1], strict=True):
                yield from work(t.slice(a, b - a))
            rest = t.slice(at[-2])
        if rest is not None and rest.num_rows:
            yield from work(rest)

    return common.map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys).select(*names), run, schema)


def _open_buckets(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """(key, node, component, main, n_main, n) of buckets with more than one component; of buckets with the same nodes, one stays.

    main is the bucket's largest component, with n_main of its n nodes.
    """
    known = buckets.select("key", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"))
    kinds = each.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_xor("x").alias("x"), F.max(F.struct("n", "component")).alias("main"))
    one = kinds.filter("parts > 1").groupBy("n", "lo", "hi", "x").agg(F.min(F.struct("key", "main")).alias("k"))
    return known.join(one.select(F.col("k.key").alias("key"), F.col("k.main.component").alias("main"), F.col("k.main.n").alias("n_main"), "n"), "key")


def _blocks(count: str) -> Column:
    return F.ceil(F.expr(count) / BLOCK)


def _dealt(members: DataFrame, sketch: DataFrame, enough: tuple[int, int]) -> DataFrame:
    """(key, node): the sub-buckets of the buckets of members (key, node), by bands of FINE coordinates drawn at random, the same for all."""
    s = enough[0] / enough[1]
    n = math.ceil(math.log(NO_BAND) / math.log(1 - s**FINE)) if s < 1 else 1

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        drawn = np.stack([np.random.default_rng(j).permutation(BINS)[:FINE] for j in range(n)])
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                low = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
                total = part.column("key").to_numpy().view(np.uint64)[:, None] * np.uint64(_STEP) + np.arange(1, n + 1, dtype=np.uint64)
                for i in range(FINE):
                    total *= np.uint64(_STEP)
                    total += low[:, drawn[:, i]]
                    total ^= total >> np.uint64(32)
                keys = _mix(total).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), n))], ["key", "node"])

    return common.map_arrow(members.select("key", "node").join(sketch.select(F.col("doc_id").alias("node"), "sketch"), "node"), run, "key long, node long")


def _block_pairs(members: DataFrame) -> DataFrame:
    """members with i, j: each pair of a bucket's blocks, but of two blocks of its main component, is a group; own is a node's block."""
    mains, rests = F.ceil(F.col("n_main") / BLOCK), F.ceil((F.col("n") - F.col("n_main")) / BLOCK)
    is_main, spread = F.col("component") == F.col("main"), F.xxhash64("node", F.lit(7))
    own = F.when(is_main, F.pmod(spread, mains)).otherwise(mains + F.pmod(spread, rests))
    others = F.sequence(F.when(is_main, mains).otherwise(F.lit(0)).cast("long"), (mains + rests - 1).cast("long"))
    rows = members.select("key", "node", "component", own.cast("long").alias("own"), F.explode(others).alias("other"))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def _maybe(sketch, component, own, same_block: bool, floor: int):
    """Rows of a block pair that may link with one of another component: boolean mask."""
    import numpy as np

    n = len(sketch)
    hit = np.zeros(n, dtype=bool)
    for k in range(n - 1):
        other = slice(k + 1, n)
        apart = component[other] != component[k]
        if not same_block:
            apart &= own[other] != own[k]
        if apart.any():
            at = np.flatnonzero(apart) + k + 1
            good = at[(sketch[at] == sketch[k]).sum(axis=1) >= floor]
            if len(good):
                hit[k] = True
                hit[good] = True
    return hit


def _residual_links(docs: DataFrame, buckets: DataFrame, components: DataFrame, sketch: DataFrame, size: int, enough) -> DataFrame:
    """A spanning set of the links between nodes of different components in one bucket."""
    floor = floor_of(enough)
    members = common.materialize(_open_buckets(buckets, components), "open_buckets")
    wide = _blocks("n_main") + _blocks("n - n_main") > WIDE
    if not members.filter(wide).isEmpty():
        dealt = common.materialize(_dealt(members.filter(wide), sketch, enough), "sub_buckets")
        members = members.filter(~wide).unionByName(_open_buckets(dealt, components))
    pairs = _block_pairs(members).join(sketch.select(F.col("doc_id").alias("node"), "sketch"), "node")
    columns = ["key", "i", "j", "own", "node", "component"]

    def first(t) -> Iterator:
        import numpy as np
        import pyarrow as pa

        s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
        hit = _maybe(s, t.column("component").to_numpy(), t.column("own").to_numpy(), t.column("i")[0] == t.column("j")[0], floor)
        if hit.any():
            yield from t.filter(pa.array(hit)).combine_chunks().to_batches()

    kept = common.materialize(_grouped(pairs.select(*columns, "sketch"), ["key", "i", "j"], first, ", ".join(f"`{c}` long" for c in columns) + ", sketch binary"), "maybe")
    if kept.isEmpty():
        return docs.sparkSession.createDataFrame([], "a long, b long")
    sets = _sets_of(docs, kept.select("node").distinct(), size, "sets_2")

    def second(t) -> Iterator:
        import numpy as np
        import pyarrow as pa

        order = np.argsort(t.column("node").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        node, comp = t.column("node").to_numpy(), t.column("component").to_numpy().copy()
        s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
        m = [np.frombuffer(x.as_py(), "<u8") for x in t.column("members")]
        a, b = [], []
        for k in range(len(node) - 1):
            at = np.flatnonzero(comp[k + 1 :] != comp[k]) + k + 1
            at = at[(s[at] == s[k]).sum(axis=1) >= floor]
            for x in at:
                if comp[x] != comp[k] and _linked(m[k], m[x], enough):
                    a.append(node[k])
                    b.append(node[x])
                    comp[comp == comp[x]] = comp[k]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _grouped(kept.join(sets, "node").select(*columns, "sketch", "members"), ["key", "i", "j"], second, "a long, b long").distinct()


def _links_of_repeated_ids(rows: DataFrame, twins: DataFrame) -> DataFrame:
    """(a, b): links of a doc_id whose rows are of more than one class with the nodes of these classes; rows: (doc_id, n_shingles, sig_a, sig_b), twins: classes of more than one row."""
    sig = F.struct("sig_a", "sig_b")
    repeated = rows.groupBy("doc_id").agg(F.min(sig).alias("lo"), F.max(sig).alias("hi"), F.count(F.lit(1)).alias("copies")).filter("lo != hi").drop("lo", "hi")
    repeated = common.materialize(repeated, "repeated_ids")
    if repeated.isEmpty():
        return rows.sparkSession.createDataFrame([], "a long, b long")
    own = common.meet(rows.filter("n_shingles > 0").select("doc_id", "sig_a", "sig_b"), repeated, ["doc_id"], "sig_a", "sig_b").distinct()
    return own.join(twins, ["sig_a", "sig_b"]).filter("node != doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()


@common.scratch("near_duplicates")
def near_duplicates(docs: DataFrame, size: int = SHINGLE, enough: tuple[int, int] = ENOUGH) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs; doc_id must be a whole number and is given as a long."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be a whole number: components are named by the least one")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = common.materialize(sketch_table(docs, size, enough), "sketches")
    some = made.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = common.materialize(classes, "classes")
    twins = classes.filter("copies > 1").drop("copies")
    of_class = some.join(twins, ["sig_a", "sig_b"], "left").filter("node is null or node = doc_id")
    bands = of_class.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first != last").select("key", "first")
    buckets = common.materialize(bands.join(shared, "key"), "buckets")

    pairs = common.materialize(buckets.filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "first_pairs")
    sketch = some.select("doc_id", "sketch")
    guess = _with_estimate(pairs, sketch).filter(F.col("equal") >= floor_of(enough))
    best = guess.groupBy("a").agg(F.max(F.struct("equal", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b"))
    best = common.materialize(best, "best")
    nodes = best.select(F.col("a").alias("node")).unionByName(best.select(F.col("b").alias("node"))).distinct()
    same = _links_of_repeated_ids(made.filter("doc_id is not null").select("doc_id", "n_shingles", "sig_a", "sig_b"), twins)
    links = common.materialize(_verified(best, _sets_of(docs, nodes, size, "sets_1"), enough).unionByName(same), "links_1")
    components = common.materialize(connected_components(links), "components_1")

    more = common.materialize(_residual_links(docs, buckets, components, sketch, size, enough), "links_2")
    if not more.isEmpty():
        components = connected_components(more.unionByName(components.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))))
    nodes = made.select("doc_id", "n_shingles", "sig_a", "sig_b").join(twins, ["sig_a", "sig_b"], "left")
    nodes = nodes.withColumn("node", F.when(F.col("n_shingles") > 0, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id"))).withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node")))
    out = nodes.join(components, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))
    return common.materialize(out, "near_duplicates")


@common.scratch("gone")
def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, enough: tuple[int, int] = ENOUGH) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component."""
    gone = near_duplicates(docs, size, enough).filter("component_id != doc_id").select("doc_id").distinct()
    return common.drop_ids(docs, common.materialize(gone, "gone"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
