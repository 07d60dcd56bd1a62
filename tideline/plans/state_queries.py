"""Queries over row state: current rows, tombstones, registers, merges, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.images import from_image_json, to_image_json
from tideline.operators.keystate import cells, conflicts, fold_changes, latest_rows, materialize, merge_states, outcomes, state_from_json, state_json
from tideline.plans.sql import over_log
from tideline.sources.change_log import change_log


def merge_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current cells when updates touch the columns that they changed."""
    return cells(materialize(fold_changes(change_log(spark, sf_dir))))


MERGE_SQL = over_log("SELECT key, name AS column, value FROM mg")


def lww_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current cells when the last write wins; images are partial, so columns that the newest lacks stay."""
    return cells(materialize(fold_changes(change_log(spark, sf_dir).withColumn("columns", F.lit(None).cast("array<string>")))))


LWW_SQL = over_log("SELECT key, name AS column, arg_max(value, v) AS value FROM lc GROUP BY key, name")


def lww_newest_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest live image of each row, the short way for images that are whole."""
    return cells(latest_rows(change_log(spark, sf_dir)))


NEWEST_SQL = over_log("SELECT lc.key, lc.name AS column, lc.value FROM lc JOIN nw ON lc.key = nw.key AND lc.v = nw.n")


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = fold_changes(change_log(spark, sf_dir)).where("delete_version is not null")
    return state.select("key", "delete_version.hlc", "delete_version.source", F.col("delete_version.ordinal").cast("long").alias("ordinal"), F.col("newest_version").isNotNull().alias("alive"))


TOMBSTONE_SQL = over_log("""SELECT x.key, x.hlc, x.source, CAST(x.ordinal AS BIGINT) AS ordinal, nw.n IS NOT NULL AS alive FROM (
  SELECT key, arg_max(hlc, v) AS hlc, arg_max(source, v) AS source, arg_max(ordinal, v) AS ordinal FROM lg WHERE op = 'd' GROUP BY key) x
LEFT JOIN nw ON x.key = nw.key""")


def state_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers read back from the state's JSON documents."""
    state = state_from_json(state_json(fold_changes(change_log(spark, sf_dir))))
    rows = state.select("key", F.explode("registers").alias("r"))
    return rows.select("key", "r.column", "r.version.hlc", "r.version.source", F.col("r.version.ordinal").cast("long").alias("ordinal"), "r.value")


REGISTER_SQL = over_log("SELECT key, name AS column, hlc, source, CAST(ordinal AS BIGINT) AS ordinal, value FROM rg")


def state_merge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log folded in three overlapping batches whose states are merged: the same as folding it once."""
    log = change_log(spark, sf_dir)
    parts = [fold_changes(log.where(cond)) for cond in ("seq % 3 <> 0", "seq % 3 <> 1", "seq % 7 = 0")]
    return cells(materialize(merge_states(*parts)))


def image_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON in column order, read back, with a column count."""
    rows = materialize(fold_changes(change_log(spark, sf_dir)))
    back = rows.select("key", from_image_json(to_image_json(F.col("row"))).alias("row"), F.col("row").alias("was"))
    return back.select("key", F.size("row").cast("long").alias("n"), F.col("row").eqNullSafe(F.col("was")).alias("same"))


IMAGE_SQL = over_log("SELECT key, count(*) AS n, true AS same FROM mg GROUP BY key")


def apply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(change_log(spark, sf_dir)).select("seq", "key", "changed", "winner_hlc", "winner_source", F.col("winner_ordinal").cast("long").alias("winner_ordinal"))


OUTCOME_SQL = over_log("""SELECT seq, key, changed, CAST(split_part(winner, '/', 1) AS BIGINT) AS winner_hlc, split_part(winner, '/', 2) AS winner_source,
  CAST(split_part(winner, '/', 3) AS BIGINT) AS winner_ordinal FROM oc""")


def conflict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts(outcomes(change_log(spark, sf_dir))).select("seq", "key", "op", "source", "winner_source")


CONFLICT_SQL = over_log("SELECT seq, key, op, source, split_part(winner, '/', 2) AS winner_source FROM oc WHERE NOT changed AND split_part(winner, '/', 2) <> source")


def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = ~F.col("changed") & (F.col("winner_source") != F.col("source"))
    return outcomes(change_log(spark, sf_dir)).groupBy("source").agg(F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"), F.count_if(lost).alias("conflicts"))


COUNT_SQL = over_log("""SELECT source, count(*) FILTER (changed) AS changed, count(*) FILTER (NOT changed) AS unchanged,
  count(*) FILTER (NOT changed AND split_part(winner, '/', 2) <> source) AS conflicts FROM oc GROUP BY source""")

QUERIES = {
    "merge_current": (merge_current, MERGE_SQL),
    "lww_current": (lww_current, LWW_SQL),
    "lww_newest_images": (lww_newest_images, NEWEST_SQL),
    "tombstones": (tombstones, TOMBSTONE_SQL),
    "state_registers": (state_registers, REGISTER_SQL),
    "state_merge_batches": (state_merge_batches, MERGE_SQL),
    "image_json": (image_json, IMAGE_SQL),
    "apply_outcomes": (apply_outcomes, OUTCOME_SQL),
    "conflicts": (conflict_rows, CONFLICT_SQL),
    "conflict_counts": (conflict_counts, COUNT_SQL),
}
