"""Joins of intervals that are near each other, as equi-joins on cells: no pair is tried that shares no cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(a: Column, b: Column, c: Column, d: Column) -> Column:
    """How far [a, b) and [c, d) are apart; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), c - b, a - d)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], radius: int, cell: int | None = None) -> DataFrame:
    """Pairs of rows with equal keys whose intervals are at most `radius` apart, with distance.

    left has start and end, right source_start and source_end (whole numbers, end not before start); other columns must
    differ. The line is cut into cells of `cell`; a row is put in each cell that its interval touches, right ones with the radius around them, and a pair counts
    in the first cell that both are in. A row is in one cell, and one more for each `cell` places of its length.
    """
    wide = cell or max(8, 2 * radius)
    at = lambda c: F.floor(c / wide)
    low, high = at(F.col("start")), at(F.col("end"))
    near, far = at(F.col("source_start") - radius), at(F.col("source_end") + radius)
    own = left.withColumn("_first", low).withColumn("_cell", F.explode(F.sequence(low, high)))
    other = right.withColumn("_near", near).withColumn("_cell", F.explode(F.sequence(near, far)))
    pairs = own.join(other, [*keys, "_cell"]).filter(F.col("_cell") == F.greatest("_first", "_near"))
    pairs = pairs.withColumn("distance", apart(F.col("start"), F.col("end"), F.col("source_start"), F.col("source_end")))
    return pairs.filter(F.col("distance") <= radius).drop("_cell", "_first", "_near")


def stab_join(left: DataFrame, points: DataFrame, keys: list[str], cell: int = 16) -> DataFrame:
    """Pairs of rows of left (start, end) and points (point) with equal keys where the point is strictly inside the interval."""
    at = lambda c: F.floor(c / cell)
    own = left.withColumn("_cell", F.explode(F.sequence(at(F.col("start")), at(F.col("end")))))
    return own.join(points.withColumn("_cell", at(F.col("point"))), [*keys, "_cell"]).filter("start < point and point < end").drop("_cell")


def first_apart(ordered: Column, kind: str | None = None) -> Column:
    """Of an array of structs with start and end those that overlap none chosen before them, in the array's order. kind: the array's type; without it the array is made twice."""
    none = F.array().cast(kind) if kind else F.slice(ordered, F.lit(1), F.lit(0))

    def take(chosen: Column, x: Column) -> Column:
        meets = F.exists(chosen, lambda c: (x["start"] < c["end"]) & (c["start"] < x["end"]))
        return F.when(meets, chosen).otherwise(F.array_append(chosen, x))

    return F.aggregate(ordered, none, take)
