"""What must hold of sessions: each check returns the rows that break it, so an empty result is good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked_paths(edges: DataFrame) -> DataFrame:
    """Path edges (text, rank, place, start, end, raw, ...) with bad: it leaves a gap, is not the text's own characters, or ends early."""
    own = Window.partitionBy("text", "rank").orderBy("place")
    last = F.row_number().over(Window.partitionBy("text", "rank").orderBy(F.desc("place"))) == 1
    gap = F.col("start") != F.coalesce(F.lag("end").over(own), F.lit(0))
    other = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("raw")
    short = last & (F.col("end") != F.length("text"))
    return edges.withColumn("bad", gap | other | short)


def counted_paths(paths: DataFrame) -> DataFrame:
    """(text, rank, edges, broken) of paths (text, rank, edges with start, end and raw): how many edges there are, and how many checked_paths() calls bad."""

    def bad(e: Column, i: Column) -> Column:
        gap = e["start"] != F.when(i == 0, F.lit(0)).otherwise(F.get("edges", i - 1)["end"])
        other = F.substr(F.col("text"), e["start"] + 1, e["end"] - e["start"]) != e["raw"]
        return gap | other | ((i == F.size("edges") - 1) & (e["end"] != F.length("text")))

    found = paths.select("text", "rank", "edges", F.size(F.filter("edges", bad)).cast("long").alias("broken"))
    return found.withColumn("edges", F.size("edges").cast("long"))


def broken_paths(edges: DataFrame) -> DataFrame:
    return checked_paths(edges).filter("bad").select("text", "rank", "place")


def checked_frames(frames: DataFrame) -> DataFrame:
    """Session frames with bad: its committed length shrinks, passes the input, or does not join up with the active part, or its work counter is no running sum."""
    own = Window.partitionBy("text").orderBy("step")
    shrinks = F.col("committed_raw_length") < F.coalesce(F.lag("committed_raw_length").over(own), F.lit(0))
    apart = F.concat(F.substr("input", F.lit(1), F.col("committed_raw_length")), "active_raw") != F.col("input")
    work = F.col("total_expanded_edges") != F.sum("expanded_edges_this_step").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prefix = ~F.startswith(F.col("output"), F.col("committed_output"))
    return frames.withColumn("bad", shrinks | apart | work | prefix | (F.col("committed_raw_length") > F.length("input")))


def broken_frames(frames: DataFrame) -> DataFrame:
    return checked_frames(frames).filter("bad").select("text", "step")


def frame_counts(frames: DataFrame) -> DataFrame:
    """(text, frames, characters): there is one frame for each character."""
    return frames.groupBy("text").agg(F.count(F.lit(1)).alias("frames")).withColumn("characters", F.length("text"))


def signature(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, signature): a digest of all other columns' rows that does not depend on their order; equal runs have equal ones."""
    text = F.concat_ws("\x1f", *(F.col(c).cast("string") for c in rows.columns if c not in keys))
    digest = F.conv(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("long")
    return rows.groupBy(*keys).agg(F.bit_xor(digest).alias("signature"))


def beam_widths(frames: DataFrame) -> DataFrame:
    """(text, widest): the most paths that a frame holds; needs nested frames."""
    return frames.groupBy("text").agg(F.max(F.size("top_paths")).alias("widest"))


def spared_work(last: DataFrame, share: float = 0.80) -> DataFrame:
    """(text, work, naive, share, spared) of the last steps of sessions: naive is what reading every prefix anew costs, spared whether work is under a share of it."""
    n = F.length("text")
    both = last.select("text", F.col("total_analyzed").alias("work"), (n * (n + 1) / 2).cast("long").alias("naive"))
    return both.withColumn("share", F.col("work") / F.col("naive")).withColumn("spared", F.col("work") < share * F.col("naive"))
