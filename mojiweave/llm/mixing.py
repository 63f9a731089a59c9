"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Sources in the order of their code points (null last) get the weights in turn and share the budget,
a share of all sizes. A target stops at MOST_REPEATS times its source's size; what is beyond is shared
anew by weight among the others until none is above. Each source's documents are shuffled by a
digest and queue up, MOST_REPEATS times over. A copy's virtual finish time is the source's tokens up
to and with it, divided by the source's target. All copies are sorted by finish time in a range
partitioning; the mix is what comes first, up to the budget, and the last copy is cut to fit. At
any time sources have finished in proportion to their targets, but for a document each.

Every sum over an order is taken in two levels, inside range partitions and over them, so neither a
source that a third of all rows have nor the whole queue is one task; the budget's end is found from
the partitions' sums, then inside the one partition that holds it. Copies that cannot be reached
before it are never made. Rows that move carry no text.

The order is that of (md5 of seed and doc_id, doc_id, size, digest of the text), so a run that is repeated,
or a task that is, takes the same words. Defined cases: a null text has size 0; a document of size 0 takes 0;
a source of which all documents have size 0 has a target of 0; a null source is a source of its own, a null doc_id an
id like any other; repeated rows are documents of their own; an empty table gives an empty result;
columns other than doc_id, text and source pass through mixture() and are not read by mix_plan().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mojiweave.llm import common

WEIGHTS = (5, 2, 1)
#: Budget as a fraction of all sizes, times a document may be taken, and what the shuffle depends on.
SHARE, MOST_REPEATS, SEED = (1, 1), 3, 13


def n_words(text: Column) -> Column:
    """The number of runs of characters that are no ASCII white space. Null: 0."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), common.WHITE, " " * len(common.WHITE)))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def _ranged(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows in a range partitioning of their order, written: part and pos tell the place."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return common.materialize(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), name)


def _before(*keys: str, by: str = "part") -> Window:
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def _ranks(sources: DataFrame) -> DataFrame:
    """sources (none, source, ...) with rank, from 0: null last, the others by code point."""
    placed = _ranged(sources, ["none", "source"], "source_order")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    base = parts.select("part", F.coalesce(F.sum("n").over(_before("all")), F.lit(0)).alias("base"))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy("pos")) - 1
    return placed.withColumn("_in", inside).join(F.broadcast(base), "part").withColumn("rank", F.col("_in") + F.col("base")).drop("part", "pos", "_in", "base")


def source_targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most_repeats: int = MOST_REPEATS) -> tuple[DataFrame, int]:
    """(none, source, source_size, largest, rank, weight, target) of each source of rows (none, source, size), written, and the budget.

    Each round that finds sources above what is theirs takes them out, by sums that the driver sees alone.
    """
    sources = rows.groupBy("none", "source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"))
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sources = common.materialize(_ranks(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * most_repeats), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget = min(total * share[0] // share[1], total * most_repeats)
    rest, w, held = budget, 1, -1
    full = F.lit(False)
    while True:  # rest / w is what a unit of weight gets; sources that stop below it leave more for the others
        s = sources.agg(F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.count_if(full)).first()
        if s[2] == held or not s[0]:
            break
        w, rest, held = s[0], budget - s[1], s[2]
        full = F.col("most").cast("decimal(19,0)") * F.lit(w).cast("decimal(18,0)") < (F.col("weight") * rest).cast("decimal(38,0)")
    target = F.when(full, F.col("most").cast("double")).otherwise((F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(w)))
    return common.materialize(sources.select("none", "source", "source_size", "largest", "rank", "weight", target.alias("target")), "targets"), budget


def _queued(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with rank, source_size, largest, target and cum, the tokens of the source up to and with the document; written."""
    own = ["none", "source"]
    placed = _ranged(rows, [*own, "turn", "doc_id", "size", "dig"], "shuffled")
    sums = placed.groupBy(*own, "part").agg(F.sum("size").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(_before(*own)), F.lit(0)))
    sums = sums.drop("s").join(sources, own)
    inside = F.sum("size").over(Window.partitionBy(*own, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    cum = (F.col("_in") + F.col("base")).alias("cum")
    joined = placed.withColumn("_in", inside).join(sums, [*own, "part"])
    return common.materialize(joined.select("id", "doc_id", "size", "rank", "source_size", "largest", "target", cum), "queued")


def _copies(queued: DataFrame, most_repeats: int) -> DataFrame:
    """queued with copy and the virtual time at which each copy is finished."""
    each = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))))
    each = each.withColumn("tokens", F.col("cum") + F.col("copy") * F.col("source_size"))
    return each.withColumn("finish", F.col("tokens").cast("double") / F.col("target"))


def _end(queued: DataFrame, budget: int, most_repeats: int) -> tuple[float, int, int, int] | None:
    """(finish, rank, tokens, words) of the copy in which the budget ends; None if all copies fit."""
    order = ["finish", "rank", "tokens"]
    # at this time every source has its target, or is exhausted: nothing that finishes later is taken
    last = queued.filter("target > 0").agg(F.max(F.lit(1.0) + F.col("largest").cast("double") / F.col("target"))).first()[0]
    if last is None:
        return None
    some = _copies(queued.filter("size > 0 and target > 0"), most_repeats).filter(F.col("finish") <= last * (1 + 1e-9))
    line = _ranged(some.select(*order, "size"), order, "queue")
    sums = line.groupBy("part").agg(F.sum("size").alias("s")).withColumn("all", F.lit(0))
    sums = sums.withColumn("base", F.coalesce(F.sum("s").over(_before("all")), F.lit(0)))  # a row for each partition
    found = sums.filter(F.col("base") + F.col("s") >= budget).orderBy("part").first()
    if found is None:
        return None
    here = line.filter(F.col("part") == found["part"])
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    at = here.select(*order, "size", (inside + F.lit(found["base"])).alias("sum")).filter(F.col("sum") >= budget).orderBy("sum").first()
    return at["finish"], at["rank"], at["tokens"], budget - (at["sum"] - at["size"])


def _taken(copy: Column, row: dict[str, Column], end) -> Column:
    """Words that the mix takes of one copy."""
    tokens = row["cum"] + copy * row["source_size"]
    if end is None:
        return row["size"]
    finish = tokens.cast("double") / row["target"]
    mine, last = F.struct(finish.alias("f"), row["rank"].alias("r"), tokens.alias("t")), F.struct(F.lit(end[0]).alias("f"), F.lit(end[1]).alias("r"), F.lit(end[2]).alias("t"))
    return F.when(row["size"] == 0, F.lit(0)).when(mine < last, row["size"]).when(mine == last, F.lit(end[3])).otherwise(F.lit(0)).cast("long")


def _plan(rows: DataFrame, weights: Sequence[int], share: tuple[int, int], most_repeats: int, seed: int) -> DataFrame:
    """(id, doc_id, size, source_size, target, takes: words of each copy, cum, rank) of rows (id, doc_id, source, size, dig)."""
    turn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    own = rows.select("id", "doc_id", "size", "dig", F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), turn.alias("turn"))
    own = common.materialize(own, "sizes")
    sources, budget = source_targets(own, weights, share, most_repeats)
    queued = _queued(own, sources)
    end = _end(queued, budget, most_repeats)
    row = {c: F.col(c) for c in ("cum", "source_size", "target", "rank", "size")}
    takes = F.transform(F.sequence(F.lit(0), F.lit(most_repeats - 1)), lambda c: _taken(c, row, end))
    return queued.select("id", "doc_id", "size", "source_size", "target", takes.alias("takes"), "cum", "rank")


def _sized(docs: DataFrame, id_: Column) -> DataFrame:
    return docs.select(id_.alias("id"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("dig"))


@common.scratch("queued")
def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most_repeats: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target (of its source) and taken, the words that the mix takes of it."""
    plan = _plan(_sized(docs, F.lit(0)), weights, share, most_repeats, seed)
    return plan.select("doc_id", "size", "source_size", "target", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"))


@common.scratch("queued", "numbered")
def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most_repeats: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of docs that are taken, once for each copy, with mix_copy and mix_time (its virtual finish time), sorted by it; the copy in which the budget ends has its first words only."""
    rows = common.packed(docs, F.monotonically_increasing_id().alias("_id"))
    rows = common.materialize(rows, "numbered")
    sized = _sized(rows.select("row.*", F.col("_id").alias("_mix_id")), F.col("_mix_id"))
    plan = _plan(sized, weights, share, most_repeats, seed)
    copies = plan.select("id", "size", "rank", "cum", "source_size", "target", F.posexplode("takes").alias("mix_copy", "_taken")).filter("_taken > 0")
    tokens = F.col("cum") + F.col("mix_copy") * F.col("source_size")
    copies = copies.select(F.col("id").alias("_id"), "size", "rank", "mix_copy", "_taken", (tokens.cast("double") / F.col("target")).alias("mix_time"))
    # each piece is a word with the white space before it
    head = F.array_join(F.slice(F.split(F.col("row.text"), r"(?<=[^ \t-\r])(?=[ \t-\r])"), F.lit(1), F.col("_taken").cast("int")), "")
    own = [c for c in docs.columns if c not in ("mix_copy", "mix_time")]
    shown = [(F.when(F.col("_taken") < F.col("size"), head).otherwise(F.col("row.text")).alias("text") if c == "text" else F.col(f"row.`{c}`")) for c in own]
    return copies.join(rows, "_id").repartitionByRange("mix_time", "rank").sortWithinPartitions("mix_time", "rank").select(*shown, "mix_copy", "mix_time")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
s AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM s0),
b AS (SELECT CAST(sum(source_size) AS BIGINT) AS budget FROM s),
rounds AS (
    SELECT 0 AS k, (SELECT budget FROM b) AS rest, (SELECT CAST(sum(weight) AS BIGINT) FROM s) AS w, CAST(0 AS BIGINT) AS held
    UNION ALL
    SELECT k + 1, n.rest, n.w, n.held FROM rounds r, LATERAL (
        SELECT (SELECT budget FROM b) - CAST(coalesce(sum(most) FILTER (WHERE most * r.w < weight * r.rest), 0) AS BIGINT) AS rest,
            CAST(coalesce(sum(weight) FILTER (WHERE NOT (most * r.w < weight * r.rest)), 0) AS BIGINT) AS w, count(*) FILTER (WHERE most * r.w < weight * r.rest) AS held FROM s) n
    WHERE n.held > r.held AND n.w > 0
),
f AS (SELECT rest, w FROM rounds ORDER BY k DESC LIMIT 1),
t AS (SELECT s.source, source_size, rank, CASE WHEN most * f.w < weight * f.rest THEN CAST(most AS DOUBLE) ELSE CAST(weight * f.rest AS DOUBLE) / CAST(f.w AS DOUBLE) END AS target FROM s, f),
q AS (
    SELECT d.doc_id, d.size, t.source_size, t.rank, t.target, row_number() OVER () AS id,
        CAST(sum(size) OVER (PARTITION BY t.rank ORDER BY md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
c AS (SELECT q.*, CAST(cum + copy * source_size AS DOUBLE) / target AS finish, cum + copy * source_size AS tokens FROM q, range(3) r(copy) WHERE size > 0 AND target > 0),
m AS (SELECT id, size, CAST(sum(size) OVER (ORDER BY finish, rank, tokens ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM c),
k AS (SELECT id, CAST(sum(greatest(0, least(size, (SELECT budget FROM b) - before))) AS BIGINT) AS taken FROM m GROUP BY id)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN k USING (id)
"""
