"""Hybrid logical clock stamps: 48 bits of milliseconds and a 16-bit counter in one BIGINT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hlc_pack(millis: Column, counter: Column) -> Column:
    return F.shiftleft(F.greatest(millis, F.lit(0)).cast("long"), 16).bitwiseOR(counter.cast("long"))


def hlc_millis(stamp: Column) -> Column:
    return F.shiftright(stamp, 16)


def hlc_counter(stamp: Column) -> Column:
    return stamp.bitwiseAND(F.lit(65535))


def stamp_transactions(txns: DataFrame, floors: DataFrame | None = None, lsns_per_range: int = 1_000_000) -> DataFrame:
    """txns (source, commit_lsn, wall_ms, ...) with hlc: in commit order within a source, each stamp is the commit's clock or
    one more than the stamp before, whichever is greater. floors (source, last_hlc) hold what earlier batches gave,
    a row a source.

    A stamp is i + max(last, max over earlier and own of clock * 65536 - position), which is a prefix maximum; positions
    and maxima are taken per range of log positions first and then over the ranges, so a source is no single task.
    """
    own = ["source", "lsn_range"]
    inside = W.partitionBy(*own).orderBy("commit_lsn")
    earlier = W.partitionBy("source").orderBy("lsn_range").rowsBetween(W.unboundedPreceding, -1)
    placed = txns.withColumn("lsn_range", F.floor(F.col("commit_lsn") / lsns_per_range))
    counts = placed.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*own, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
    clock = F.greatest(F.col("wall_ms"), F.lit(0)) * 65536
    placed = placed.join(counts, own).withColumn("position", F.col("rows_before") + F.row_number().over(inside))
    placed = placed.withColumn("lead", clock - F.col("position"))
    tops = placed.groupBy(*own).agg(F.max("lead").alias("top"))
    tops = tops.select(*own, F.max("top").over(earlier).alias("lead_before"))
    placed = placed.join(tops, own)
    floor = F.lit(0).cast("long")
    if floors is not None:
        placed = placed.join(F.broadcast(floors.select("source", F.col("last_hlc").alias("last_floor"))), "source", "left")
        floor = F.coalesce("last_floor", floor)
    stamp = F.col("position") + F.greatest(floor, F.coalesce("lead_before", F.col("lead")), F.max("lead").over(inside))
    return placed.withColumn("hlc", stamp).select(*txns.columns, "hlc")
