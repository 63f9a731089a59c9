"""What the operators share: shared scratch tables, worker caches, a bounded id filter."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word contracts name it: \x20 and \x09-\x0D.
WHITE = " \t\n\v\f\r"

#: Bytes of an Arrow batch that goes to a Python worker, at most (beyond a single row): what a worker and
#: the JVM beside it hold at once does not depend on how long texts are.
BATCH_BYTES = 8 << 20

_made: list[list[str]] = []
_own: list[str] = []


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_BYTES; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(now[-1:], 1)
    if int(now.rstrip("kmgt")) * unit > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a single-process local session without that setting gets a folder of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:  # a session does not take this setting while it runs
        _own.append(tempfile.mkdtemp(prefix="mojiweave-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/mw-{uuid.uuid4().hex}/{name}"
    for paths in _made:
        paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: its lineage is cut, and no executor holds the only copy."""
    bound_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_paths() -> Iterator[list[str]]:
    """Collects the scratch tables made inside, so that their maker can drop them when they were read."""
    paths: list[str] = []
    _made.append(paths)
    try:
        yield paths
    finally:
        _made[:] = [x for x in _made if x is not paths]  # equal lists are not the same one


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        folder = jvm.org.apache.hadoop.fs.Path(p).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


def scratch(*kept: str):
    """For an operator: its scratch tables go when it returns, but those of the names `kept`, which its lazy result still reads; all go if it fails."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **named):
            names: tuple[str, ...] = ()
            with scratch_paths() as made:
                try:
                    out, names = f(*args, **named), kept
                finally:
                    drop_paths(SparkSession.active(), [p for p in made if p.rpartition("/")[2] not in names])
            return out

        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one column, row, beside columns of the caller's own: no name of theirs can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *more)


def keyed(docs: DataFrame) -> DataFrame:
    """row, text, _doc, the doc_id (null: the least value), and _dig, a digest that tells rows of one doc_id apart.

    Whole numbers are kept as longs; a doc_id of another type is taken as text.
    """
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    doc = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("long") if whole else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return packed(docs, F.col("text"), doc.alias("_doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_dig"))


def doc_type(keyed_docs: DataFrame) -> str:
    return keyed_docs.schema["_doc"].dataType.simpleString()


def ddl(docs: DataFrame, *without: str) -> str:
    """The columns of docs as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in without)


def worker_store(name: str, make):
    """A value that lives as long as the Python worker process, over all its tasks."""
    home = sys.modules.setdefault("_mojiweave_worker", types.ModuleType("_mojiweave_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def tidy_worker(*keep: str) -> None:
    """Drops what worker_store() holds under other names and gives freed memory back: workers live through many stages."""
    import ctypes
    import gc

    import pyarrow as pa

    home = sys.modules.get("_mojiweave_worker")
    for name in [n for n in vars(home or object) if not n.startswith("__") and n not in keep] if home else ():
        delattr(home, name)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema, *keep: str) -> DataFrame:
    """df.mapInArrow(run, schema) in a worker that starts and ends tidy, but for the named stores."""

    def tidied(batches: Iterator) -> Iterator:
        tidy_worker(*keep)
        yield from run(batches)
        tidy_worker(*keep)

    return df.mapInArrow(tidied, schema)


# --- filters over 64-bit keys, sized by their number -------------------------------------------

_CHUNK_BITS = 8 * 4096  # what bitmap_construct_agg holds in a row


def filter_bits(n: int) -> int:
    """Bits of a filter of n keys: 16 for each, between 2**22 and 2**29 (64 MB), a power of two.

    Beyond some 10**8 keys more passes than need be; what passes is joined exactly afterwards, so only work grows.
    """
    return 1 << min(29, max(22, (16 * n - 1).bit_length()))


def _chunks(keys: DataFrame, key: Column, size: int) -> DataFrame:
    """(_chunk, _bits) of a one-hash filter, combined before the shuffle."""
    slot, bits = F.pmod(F.coalesce(key, F.lit(0)), F.lit(size)), F.lit(_CHUNK_BITS)
    return keys.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / bits).alias("_chunk")).agg(F.bitmap_construct_agg(F.pmod(F.col("slot"), bits)).alias("_bits"))


def key_bits(keys: DataFrame, key: Column) -> bytes:
    """The filter of a column of longs, for key_test() in Python workers; keys must be a written table. At most 64 MB reach the driver."""
    size = filter_bits(keys.count())
    out = bytearray(size // 8)
    for r in _chunks(keys, key, size).toLocalIterator():
        out[r["_chunk"] * 4096 : (r["_chunk"] + 1) * 4096] = r["_bits"]
    return bytes(out)


def key_test(bits: bytes):
    """numpy test of longs against key_bits(); a false answer is certain."""
    import numpy as np

    held = np.frombuffer(bits, dtype=np.uint8)

    def test(keys):
        slots = keys % (8 * len(held))
        return (held[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1

    return test


def marked(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """df with _maybe: whether key may be among the values of keys' one column; a false answer is certain.

    The filter is broadcast: its size follows the number of keys up to the bound of filter_bits().
    """
    size, bits = filter_bits(keys.count()), F.lit(_CHUNK_BITS)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), F.pmod(F.col("_place"), F.lit(8)) + 1)) != 0, F.lit(False))
    placed = df.withColumn("_slot", F.pmod(F.coalesce(F.xxhash64(key), F.lit(0)), F.lit(size)))
    placed = placed.withColumn("_chunk", F.floor(F.col("_slot") / bits)).withColumn("_place", F.pmod(F.col("_slot"), bits).cast("int"))
    chunks = _chunks(keys, F.xxhash64(keys.columns[0]), size)
    return placed.join(F.broadcast(chunks), "_chunk", "left").withColumn("_maybe", maybe).drop("_slot", "_chunk", "_place", "_bits")


#: From so many rows on a key is hot for meet(): its rows are dealt over SALTS parts.
HOT_ROWS, SALTS = 2_000, 64


def meet(rows: DataFrame, keys: DataFrame, on: list[str], *spread: str) -> DataFrame:
    """rows joined with keys (a written table, each key once, copies: how many rows have it) on the longs `on`.

    Keys of HOT_ROWS copies or more, and what shares their places in a filter, are dealt over SALTS
    parts by the columns `spread` of rows, so a key that a third of all rows have is not one task.
    """
    hot = keys.filter(F.col("copies") >= HOT_ROWS).select(F.xxhash64(*on).alias("h"))
    known, held = (marked(x, F.xxhash64(*on), hot) for x in (rows, keys.drop("copies")))
    dealt = held.filter("_maybe").drop("_maybe").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = known.filter("_maybe").withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(dealt, [*on, "_salt"]).drop("_salt", "_maybe")
    return some.unionByName(known.filter("not _maybe").join(held.filter("not _maybe").drop("_maybe"), on).drop("_maybe"))


def meet_marked(rows: DataFrame, keys: DataFrame, on: list[str], *spread: str) -> DataFrame:
    """meet() of rows and keys that hold _maybe, the answer of one filter of the hot keys' values: one join, in which a key that is not hot has one part."""
    parts = F.when(F.col("_maybe"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = keys.withColumn("_salt", F.explode(parts)).drop("_maybe")
    salt = F.when(F.col("_maybe"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.withColumn("_salt", salt).drop("_maybe").join(dealt, [*on, "_salt"]).drop("_salt")


def with_few(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """rows with the further columns of few (a written table, each key once; no null in a key), null where a row's key is not in it.

    Only rows that pass a filter sized by the number of few meet it in a join: the others are not shuffled.
    """
    known = marked(rows, F.xxhash64(*on), few.select(F.xxhash64(*on).alias("h")))
    rest = known.filter("not _maybe").drop("_maybe").select("*", *(F.lit(None).cast(few.schema[c].dataType).alias(c) for c in few.columns if c not in on))
    return known.filter("_maybe").drop("_maybe").join(few, on, "left").select(*rest.columns).unionByName(rest)


def drop_matching(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """The rows of docs whose keys are not among the rows of gone (each once; a written table); null is a value like any other.

    Only rows that pass a filter sized by the number of gone meet it in a join, so texts that stay are not shuffled.
    """
    own, other = [f"_k{i}" for i in range(len(keys))], [f"_g{i}" for i in range(len(keys))]
    rows = marked(packed(docs, *(k.alias(n) for k, n in zip(keys, own, strict=True))), F.xxhash64(*own), gone.select(F.xxhash64(*(f"`{c}`" for c in gone.columns)).alias("h")))
    same = None
    for a, b in zip(own, other, strict=True):
        same = F.col(a).eqNullSafe(F.col(b)) if same is None else same & F.col(a).eqNullSafe(F.col(b))
    open_ = rows.filter("_maybe").join(gone.toDF(*other), same, "left_anti")
    return rows.filter("not _maybe").select("row.*").unionByName(open_.select("row.*"))


def drop_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in gone (doc_id, each once; a written table)."""
    return drop_matching(docs, [F.col("doc_id")], gone.select("doc_id"))
