"""Places, ranks and running numbers of large groups, taken in ranges first, so that no group is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_places(rows: DataFrame, by: str, order: str, width: int = 1_000_000) -> DataFrame:
    """rows with place: from 1 within each `by`, in order of a long column that has no value twice in a group. Rows are numbered
    in ranges of `width` values of that column, and the ranges' counts are summed up before them."""
    ranged = rows.withColumn("place_range", F.floor(F.col(order) / width))
    counts = ranged.groupBy(by, "place_range").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy(by).orderBy("place_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(by, "place_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("places_before"))
    inside = F.row_number().over(W.partitionBy(by, "place_range").orderBy(order))
    return ranged.join(counts, [by, "place_range"]).withColumn("place", F.col("places_before") + inside).drop("place_range", "places_before")


def values_at(values: DataFrame, value: str, by: list[str], ranks: dict[str, Column], width: int = 1_000) -> DataFrame:
    """by, n and, for each name in ranks, the value at that place in order (from 1; a column of n, the group's size). Equal values
    are counted together first, then ranges of `width` (of whole numbers), and only distinct values of one range are put
    in order at a time."""
    counts = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("times")).withColumn("value_range", F.floor(F.col(value) / width))
    totals = counts.groupBy(*by, "value_range").agg(F.sum("times").alias("in_range"))
    group = W.partitionBy(*by)
    earlier = group.orderBy("value_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "value_range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("before"), F.sum("in_range").over(group).alias("n"))
    upto = F.col("before") + F.sum("times").over(W.partitionBy(*by, "value_range").orderBy(value))
    placed = counts.join(totals, [*by, "value_range"]).withColumn("upto", upto)
    here = lambda rank: (rank > F.col("upto") - F.col("times")) & (rank <= F.col("upto"))
    return placed.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(here(rank), F.col(value))).alias(name) for name, rank in ranks.items()])
