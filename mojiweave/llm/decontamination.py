"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is 10 consecutive words of an item (an item of fewer words is one window as a whole). A
document word inside any occurrence of a window is hit. Of both sides, every K-gram is hashed and
in each run of W consecutive K-grams the one with the smallest hash is kept; as K + W - 1 is the
window's length, an occurrence of a window always keeps the same K-gram as the window itself.
Equal fingerprints are joined, and each hit is extended: the windows around it are compared word
by word with the item's. Items shorter than a window are looked up by all grams of their length.

The benchmark's fingerprints are broadcast only if a count of them is under BROADCAST_ROWS;
otherwise both joins shuffle, and what is shuffled is the few words around a fingerprint; the row that
each document has of its own, whatever it holds, takes no part in them.

Defined cases: a null or wordless text has n_words 0 and no hit; an item without words has no
window; a null item_id counts its hits but is not listed; rows that repeat a doc_id are judged one
by one; repeated items or windows count once; an empty table on either side leaves every document
clean; columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.llm import common

WINDOW, K = 10, 6
W = WINDOW - K + 1
#: Fingerprints or windows of a benchmark that are broadcast at most (some 100 MB).
BROADCAST_ROWS = 1_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All ASCII characters that are no letter or digit; the first is kept as the separator.
_APART = " " + "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != " ")


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; null: none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _APART, _UPPER.lower() + " " * len(_APART))
    return F.array_remove(F.split(plain, " "), "")


def _at(a: Column, i: Column, n: int) -> list[Column]:
    return [F.get(a, i + k) for k in range(n)]


def fingerprints(rows: DataFrame, short: list[int]) -> DataFrame:
    """rows (with words) with fps added: array<struct<n, fp, at>>.

    n = 0: the K-grams that winnowing keeps, with their places from 0; n > 0: all grams of n words,
    for each n in short. Each step is a projection of its own, so that no array is computed twice;
    for the same reason the arrays are exploded by outer generators, under which Spark infers no
    filter that would repeat the whole chain.
    """
    names = rows.columns
    rows = rows.select(*names, F.transform("words", lambda w: F.xxhash64(w)).alias("_h"))
    grams = F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_h") - K), lambda i: F.xxhash64(*_at(F.col("_h"), i, K))))
    rows = rows.select(*names, "_h", grams.alias("_g"))
    lows = F.transform(F.sequence(F.lit(0), F.size("_g") - W), lambda i: F.least(*_at(F.col("_g"), i, W)))
    rows = rows.select(*names, "_h", "_g", F.when(F.col("_g").isNotNull(), lows).alias("_low"))
    # kept: equal to the least of some run that covers it, that is to the largest of those runs' leasts
    kept = F.filter(F.sequence(F.lit(0), F.size("_g") - 1), lambda i: F.get(F.col("_g"), i) == F.greatest(*_at(F.col("_low"), i - W + 1, W)))
    rows = rows.select(*names, "_h", "_g", F.when(F.col("_g").isNotNull(), kept).alias("_kept"))
    none = F.array().cast("array<struct<n:int,fp:bigint,at:int>>")
    parts = [F.coalesce(F.transform("_kept", lambda i: F.struct(F.lit(0).alias("n"), F.get(F.col("_g"), i).alias("fp"), i.alias("at"))), none)]

    def all_grams(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size("_h") - n), lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(*_at(F.col("_h"), i, n)).alias("fp"), i.alias("at")))
        return F.when(F.size("_h") >= n, each).otherwise(none)

    parts += map(all_grams, short)
    return rows.select(*names, F.concat(*parts).alias("fps"))


def _item_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(n, fp) of all items, (m, window, items) of all windows, and the lengths of the short items."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = common.materialize(items, "items")
    short = sorted(r[0] for r in items.filter(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())  # at most WINDOW - 1 numbers
    lone = F.when(F.size("words") < WINDOW, F.size("words"))
    fps = fingerprints(items, short).select(lone.alias("lone"), F.inline_outer("fps")).filter((F.col("n") == 0) | (F.col("n") == F.col("lone")))
    m = F.least(F.size("words"), F.lit(WINDOW))
    starts = items.select("item_id", "words", m.alias("m"), F.explode(F.sequence(F.lit(0), F.size("words") - m)).alias("i"))
    windows = starts.select("item_id", "m", F.array_join(F.slice("words", F.col("i") + 1, F.col("m")), " ").alias("window"))
    windows = windows.groupBy("m", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return common.materialize(fps.select("n", "fp").distinct(), "item_fps"), common.materialize(windows, "item_windows"), short


@common.scratch("item_fps", "item_windows")
def find_hits(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans array<struct<start, length>> (words, from 0) and items (ids of the items that occur)."""
    fps, windows, short = _item_tables(benchmark)
    small = fps.count() <= broadcast_rows and windows.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda x: x)
    # rows are told apart by what they hold, not by a number, which would change if a task ran again elsewhere
    docs = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("dig"), "doc_id", words_of(F.col("text")).alias("words"))
    counts = docs.select("dig", "doc_id", F.size("words").alias("n_words"))
    whole = F.array(F.struct(F.lit(-1).alias("n"), F.lit(None).cast("bigint").alias("fp"), F.lit(None).cast("int").alias("at")))  # one row for each document
    held = F.concat("fps", whole) if small else F.col("fps")
    keys = fingerprints(docs, short).select("dig", "doc_id", "words", F.inline_outer(held))

    def around(rows: DataFrame, *more: str) -> DataFrame:
        first = F.when(F.col("n") == 0, F.greatest(F.col("at") - (W - 1), F.lit(0))).otherwise(F.col("at"))
        last = F.when(F.col("n") == 0, F.least(F.col("at"), F.size("words") - WINDOW)).otherwise(F.col("at"))
        m = F.when(F.col("n") == 0, F.lit(WINDOW)).when(F.col("n") > 0, F.col("n"))
        near = F.when(F.col("n") >= 0, F.slice("words", first + 1, last - first + m))
        return rows.select("dig", "doc_id", *more, F.when(F.col("n") < 0, F.size("words")).alias("n_words"), m.alias("m"), first.alias("first"), last.alias("last"), near.alias("near"))

    fps = hint(fps.withColumn("_known", F.lit(True)))
    wanted = (F.col("n") < 0) | F.col("_known")
    if small:
        found = around(keys.join(fps, ["n", "fp"], "left").filter(wanted))
    else:
        found = around(keys.filter("fp is not null"), "n", "fp").join(fps, ["n", "fp"]).drop("n", "fp", "_known", "n_words")
    each = found.withColumn("start", F.explode_outer(F.when(F.col("first").isNotNull(), F.sequence("first", "last"))))
    each = each.withColumn("window", F.array_join(F.slice("near", F.col("start") - F.col("first") + 1, F.col("m")), " ")).drop("near", "first", "last")
    if small:
        hits = each.join(hint(windows), ["m", "window"], "left").filter(F.col("items").isNotNull() | F.col("n_words").isNotNull())
    else:
        hits = each.join(windows, ["m", "window"]).unionByName(counts, allowMissingColumns=True)
    span = F.when(F.col("items").isNotNull(), F.struct("start", F.col("m").alias("length")))
    return (
        hits.groupBy("dig", "doc_id")
        .agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("items").alias("items"))
        .select("doc_id", "n_words", "spans", F.array_distinct(F.flatten("items")).alias("items"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .drop("copy")
    )


@common.scratch("contaminated")
def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold any window of the benchmark; all rows of such a doc_id go."""
    bad = find_hits(docs, benchmark).filter(F.size("spans") > 0).select("doc_id").distinct()
    return common.drop_ids(docs, common.materialize(bad, "contaminated"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    ids = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return hits.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, row_no, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT d.*, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM wins) WHERE len(w) >= m)
), occ AS (
  SELECT row_no, i, wins.m, item_id FROM grams JOIN wins ON grams.m = wins.m AND grams.g = wins.g
), hit AS (
  SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(i, i + m)) AS p FROM occ) GROUP BY row_no
), its AS (
  SELECT row_no, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT row_no, CAST(item_id AS VARCHAR) AS x FROM occ WHERE item_id IS NOT NULL) GROUP BY row_no
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row_no) LEFT JOIN its USING (row_no)
"""
