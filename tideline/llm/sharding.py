"""Sharding over fixed virtual slots, in DataFrame functions only.

A record's id is hashed into one of `n_slots` slots, which never changes. Bytes are summed per slot, and a slot map, a
table of n_slots rows with a version, gives each slot a shard: slots go in descending bytes to the shard with the
fewest bytes so far. Rebalancing edits the map into a next version that moves few slots; records are never rehashed.

The map has n_slots rows whatever the data (a parameter), so it is folded in one row and joined as a small table.

Defined cases: null text counts 1 byte; null ids are hashed by their text; equal rows are neighbours in their slot; an
empty table gives a map in which every slot has 0 bytes and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import shared_path, text_or_empty


def virtual_slot(n_slots: int) -> Column:
    """From an md5 of the id, so that every engine can compute it."""
    identity = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text_or_empty())))
    return (F.conv(F.substring(F.md5(identity), 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def record_size() -> Column:
    return F.octet_length(text_or_empty()).cast("long") + 1


def sharding_rows(docs: DataFrame, n_slots: int) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every document."""
    return docs.select(
        "doc_id", record_size().alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), virtual_slot(n_slots).alias("virtual_slot")
    )


def slot_totals(rows: DataFrame, n_slots: int) -> DataFrame:
    """virtual_slot, slot_bytes, slot_rows for each of the n_slots slots."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))
    every = rows.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").fillna(0, ["slot_bytes", "slot_rows"])


def build_slot_map(totals: DataFrame, n_shards: int) -> DataFrame:
    """version 1: slots in descending bytes, each to the shard with the fewest bytes so far (the lowest of equals)."""
    slots = F.array_sort(F.collect_list(F.struct((-F.col("slot_bytes")).alias("minus"), "virtual_slot", "slot_rows")))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"),
        F.array().cast("array<struct<virtual_slot:int,shard:int,slot_bytes:bigint,slot_rows:bigint>>").alias("owners"),
    )

    def place(state: Column, slot: Column) -> Column:
        shard = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        owner = F.struct(
            slot["virtual_slot"].alias("virtual_slot"), shard.alias("shard"), (-slot["minus"]).alias("slot_bytes"), slot["slot_rows"].alias("slot_rows")
        )
        loads = F.transform(state["loads"], lambda load, i: F.when(i == shard, load - slot["minus"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(state["owners"], F.array(owner)).alias("owners"))

    folded = totals.agg(F.aggregate(slots, start, place)["owners"].alias("owners"))
    return folded.select(F.inline("owners")).withColumn("version", F.lit(1))


def rebalance_slot_map(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version after one shard is added: every old shard gives slots to the new one (n_shards - 1), small ones
    first, as long as it keeps an equal share of the bytes. No slot moves between old shards, and records stay in their slots."""
    share = F.sum("slot_bytes").over(W.partitionBy()) / F.lit(n_shards)
    own = W.partitionBy("shard")
    spare = F.sum("slot_bytes").over(own) - share
    given = F.sum("slot_bytes").over(own.orderBy("slot_bytes", "virtual_slot"))
    moves = (given <= spare) & (F.col("slot_bytes") > 0)
    edited = slot_map.withColumn("shard", F.when(moves, F.lit(n_shards - 1)).otherwise(F.col("shard")).cast("int"))
    return edited.withColumn("version", F.col("version") + 1)


def save_slot_map(slot_map: DataFrame, path: str) -> None:
    """Adds this version to the versions kept at path."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_slot_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the latest by default."""
    kept = spark.read.schema("virtual_slot int, shard int, slot_bytes bigint, slot_rows bigint, version int").parquet(path)
    if version is None:
        version = kept.agg(F.max("version")).first()[0]
    return kept.where(F.col("version") == version)


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = 4096, slot_map: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, position (gapless from 0 in the shard), virtual_slot, map_version.

    Without a slot_map one is built from these documents, stored as version 1 and read back.
    """
    spark = docs.sparkSession
    rows = sharding_rows(docs, n_slots)
    totals = slot_totals(rows, n_slots)
    if slot_map is None:
        path = shared_path(spark, "slot-map")
        save_slot_map(build_slot_map(totals, n_shards), path)
        slot_map = load_slot_map(spark, path)
    else:
        slot_map = slot_map.drop("slot_bytes", "slot_rows").join(totals, "virtual_slot")
    earlier = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    placed = slot_map.select(
        "virtual_slot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("slot_rows").over(earlier), F.lit(0)).alias("rows_before")
    )
    place = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")) - 1
    return (
        rows.withColumn("place", place)
        .join(placed, "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("place")).alias("position"), "virtual_slot", "map_version")
    )
