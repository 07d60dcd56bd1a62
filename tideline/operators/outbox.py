"""The ordered change log as a store: scans, heads, positions, appends and pruning."""

from __future__ import annotations

import os
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class StaleEpoch(RuntimeError):
    """A writer's source has been taken over since."""


def read_range(log: DataFrame, source: str, after_seq: int, from_lsn: int, tables: list[str], limit: int) -> DataFrame:
    """The next changes of a source past a cursor, in order. A page: limit is part of the request."""
    wanted = (F.col("source") == source) & (F.col("seq") > after_seq) & (F.col("commit_lsn") >= from_lsn) & F.col("table_name").isin(tables)
    return log.where(wanted).orderBy("seq").limit(limit)


def last_seq_before(log: DataFrame, lsns: DataFrame) -> DataFrame:
    """source, lsn, seq: of the change with the greatest (commit_lsn, seq) before lsn; 0 if there is none. Each change counts
    for the least of its source's positions that lies past it, in one aggregation of the log; maxima then run over positions."""
    asked = lsns.select("source", "lsn").distinct()
    per_source = asked.groupBy("source").agg(F.array_sort(F.collect_list("lsn")).alias("lsns"))
    next_lsn = F.array_min(F.filter("lsns", lambda x: x > F.col("commit_lsn")))
    tops = log.join(per_source, "source").select("source", next_lsn.alias("lsn"), "commit_lsn", "seq").where("lsn is not null")
    tops = tops.groupBy("source", "lsn").agg(F.max(F.struct("commit_lsn", "seq")).alias("top"))
    best = F.max("top").over(W.partitionBy("source").orderBy("lsn"))
    return asked.join(tops, ["source", "lsn"], "left").select("source", "lsn", F.coalesce(best["seq"], F.lit(0)).alias("seq"))


def heads(log: DataFrame) -> DataFrame:
    """source, head_seq."""
    return log.groupBy("source").agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head_seq"))


def positions(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """sink_id, source, head_seq, head_lsn, pending_lsn, pending_ms (commit of the oldest change past the cursor). The log is
    aggregated once for all cursors: by the greatest of its source's cursors that a change lies past; minima then run back over
    the cursors, of which a source has one a sink."""
    per_source = cursors.groupBy("source").agg(F.array_sort(F.collect_set("last_seq")).alias("marks"))
    mark = F.array_max(F.filter("marks", lambda x: x < F.col("seq")))
    parts = log.join(per_source, "source").select("source", mark.alias("mark"), F.struct("seq", "commit_lsn", "commit_ms").alias("change"))
    parts = parts.groupBy("source", "mark").agg(F.min("change").alias("first"), F.max("change").alias("last"))
    top = parts.groupBy("source").agg(F.max("last").alias("head"))
    marks = per_source.select("source", F.explode("marks").alias("last_seq")).join(parts.select("source", F.col("mark").alias("last_seq"), "first"), ["source", "last_seq"], "left")
    later = W.partitionBy("source").orderBy("last_seq").rowsBetween(0, W.unboundedFollowing)
    marks = marks.withColumn("next", F.min("first").over(later))
    found = cursors.select("sink_id", "source", "last_seq").join(marks, ["source", "last_seq"]).join(top, "source", "left")
    return found.select("sink_id", "source", F.coalesce("head.seq", F.lit(0)).alias("head_seq"), F.col("head.commit_lsn").alias("head_lsn"), F.col("next.commit_lsn").alias("pending_lsn"), F.col("next.commit_ms").alias("pending_ms"))


def prunable_seqs(cursors: DataFrame, sinks: DataFrame) -> DataFrame:
    """source, upto: the slowest durable sink's cursor. Index sinks rebuild themselves and hold nothing back."""
    durable = cursors.join(sinks.where("kind <> 'index'").select("sink_id"), "sink_id")
    return durable.groupBy("source").agg(F.min("last_seq").alias("upto"))


def retained(log: DataFrame, cursors: DataFrame, sinks: DataFrame, cutoff_ms: int) -> DataFrame:
    """What pruning keeps: changes newer than the cutoff or past the slowest durable cursor of their source; with no durable
    sink age alone decides."""
    floors = prunable_seqs(cursors, sinks)
    joined = log.join(floors, "source", "left")
    gone = (F.col("commit_ms") < cutoff_ms) & (F.col("seq") <= F.coalesce("upto", F.lit(2**63 - 1)))
    return joined.where(~gone).drop("upto")


def accepted_batches(batches: DataFrame, claims: DataFrame) -> DataFrame:
    """Batches (source, epoch, at, ...) whose writer owned its source when it wrote them. claims: source, epoch, at of every
    take-over; a source belongs to the greatest epoch claimed so far, and what it stored before stays."""
    made = claims.select(F.col("source").alias("claimed"), F.col("epoch").alias("claim"), F.col("at").alias("claimed_at"))
    so_far = (F.col("source") == F.col("claimed")) & (F.col("claimed_at") <= F.col("at"))
    owned = batches.join(made, so_far & (F.col("claim") == F.col("epoch")), "left_semi")
    return owned.join(made, so_far & (F.col("claim") > F.col("epoch")), "left_anti")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), f"tideline-{os.getpid()}")


def stored_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder, none if nothing was written to it yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
        return spark.createDataFrame([], schema)


def epochs(spark: SparkSession, path: str) -> DataFrame:
    """source, epoch: who owns each source of an outbox. One small row a take-over."""
    return stored_rows(spark, f"{path}/_epochs", "source string, epoch long").groupBy("source").agg(F.max("epoch").alias("epoch"))


def claim(spark: SparkSession, path: str, source: str) -> int:
    """Takes a source of an outbox over; returns the new epoch, with which its batches are to be written."""
    owner = epochs(spark, path).where(F.col("source") == source).first()
    epoch = 1 + (owner.epoch if owner else 0)
    spark.createDataFrame([(source, epoch)], "source string, epoch long").write.mode("append").parquet(f"{path}/_epochs")
    return epoch


def append_batch(changes: DataFrame, path: str, batch_id: int, owned: dict[str, int] | None = None) -> None:
    """Writes one batch under its number, replacing an earlier try of the same batch, so a repeated batch adds nothing. owned:
    the writer's epoch of each source that it writes; StaleEpoch is raised, before anything is written, if one of these sources
    has been claimed by another since. Without it nothing is fenced."""
    if owned is not None:
        now = {r.source: r.epoch for r in epochs(changes.sparkSession, path).where(F.col("source").isin(list(owned))).collect()}
        stale = sorted(s for s, epoch in owned.items() if now.get(s) != epoch)
        if stale:
            raise StaleEpoch(f"taken over: {', '.join(stale)}")
    changes.write.mode("overwrite").partitionBy("source").parquet(f"{path}/batch={batch_id}")


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def checkpoint_reached(positions: DataFrame, lsn: Column) -> DataFrame:
    """reached: whether any stored position (confirmed_lsn) is at lsn or past it; false without positions."""
    return positions.agg(F.coalesce(F.bool_or(F.col("confirmed_lsn") >= lsn), F.lit(False)).alias("reached"))
