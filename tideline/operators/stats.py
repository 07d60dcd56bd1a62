"""Counters, lags, rates, feeds and checks over a change log and its deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.ranges import values_at


def capture_counters(log: DataFrame, txns: DataFrame) -> DataFrame:
    """source, changes, txns (without changes too), last_commit_ms."""
    per_log = log.groupBy("source").agg(F.count(F.lit(1)).alias("changes"))
    per_txn = txns.groupBy("source").agg(F.count(F.lit(1)).alias("txns"), F.max("commit_ms").alias("last_commit_ms"))
    return per_txn.join(per_log, "source", "left").select("source", F.coalesce("changes", F.lit(0)).alias("changes"), "txns", "last_commit_ms")


def nearest_rank(values: DataFrame, value: str, by: list[str], quantile: float) -> DataFrame:
    """by, nearest: the value at place ceil(quantile * n) in order."""
    return values_at(values, value, by, {"nearest": F.greatest(F.lit(1), F.ceil(F.lit(quantile) * F.col("n")))}).select(*by, "nearest")


def lag_summary(lags: DataFrame, lag: Column) -> DataFrame:
    """source, n, p50, p95, p99, most of lags in ms; snapshot rows (clock 0) do not count. A percentile lies between the values
    at the places to either side of q * (n - 1), in proportion."""
    quantiles = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    ranks = {f"{name}_low": F.floor(place(q)) + 1 for name, q in quantiles.items()} | {f"{name}_high": F.ceil(place(q)) + 1 for name, q in quantiles.items()}
    found = values_at(lags.where("hlc <> 0").select("source", lag.alias("lag")), "lag", ["source"], ranks | {"most": F.col("n")})
    between = lambda name, q: F.round(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (place(q) - F.floor(place(q)))).cast("long").alias(name)
    return found.select("source", "n", *[between(name, q) for name, q in quantiles.items()], "most")


def sink_lags(positions: DataFrame, now_ms: Column) -> DataFrame:
    """sink_id, source, lag_ms: since the oldest pending commit; 0 if there is none."""
    lag = F.when(F.col("pending_ms").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), now_ms - F.col("pending_ms")))
    return positions.select("sink_id", "source", lag.cast("long").alias("lag_ms"))


def worst_lags(lags: DataFrame) -> DataFrame:
    return lags.groupBy("sink_id").agg(F.max("lag_ms").alias("lag_ms"))


def throughput(samples: DataFrame) -> DataFrame:
    """name, at_ms, per_second of running counters (name, at_ms, total); 0 for the first sample, a reset or no time passed."""
    w = W.partitionBy("name").orderBy("at_ms")
    span, grown = F.col("at_ms") - F.lag("at_ms").over(w), F.col("total") - F.lag("total").over(w)
    rate = F.when(span.isNull() | (span <= 0) | (grown < 0), F.lit(0)).otherwise(F.floor(grown * 1000 / span))
    return samples.select("name", "at_ms", rate.cast("long").alias("per_second"))


def latest(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The n latest rows of each group."""
    w = W.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def sampled_feed(log: DataFrame, per_second: int = 5) -> DataFrame:
    """The first changes of each source and second of commit time."""
    second = F.floor(F.col("commit_ms") / 1000)
    w = W.partitionBy("source", "second").orderBy("seq")
    return log.withColumn("second", second).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_second)


def inversions(applied: DataFrame) -> DataFrame:
    """inversions: how often a row's later application has a smaller seq (key, n, seq)."""
    w = W.partitionBy("key").orderBy("n")
    return applied.withColumn("back", F.col("seq") < F.lag("seq").over(w)).agg(F.count_if("back").alias("inversions"))


def table_digest(rows: DataFrame, by: str, order: str, columns: list[str], width: int = 1_000) -> DataFrame:
    """by, digest: the md5 of a group's ranges' md5s in order, a range being `width` values of the long column `order`, and a
    range's md5 that of its rows' md5s in order of text. No more than a range, or a digest of each, is held at once."""
    line = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))
    ranges = rows.groupBy(by, F.floor(F.col(order) / width).alias("part")).agg(F.md5(F.concat_ws(",", F.array_sort(F.collect_list(line)))).alias("digest"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"])
    return ranges.groupBy(by).agg(F.md5(F.concat_ws(",", ordered)).alias("digest"))


def lost_writes(acknowledged: DataFrame, stored: DataFrame) -> DataFrame:
    """lost: acknowledged rows (key, seq) that are missing or older in stored."""
    joined = acknowledged.join(stored.select("key", F.col("seq").alias("stored_seq")), "key", "left")
    return joined.agg(F.count_if(F.col("stored_seq").isNull() | (F.col("stored_seq") < F.col("seq"))).alias("lost"))


def slot_health(slots: DataFrame) -> DataFrame:
    """Slots (name, current_lsn, restart_lsn, confirmed_lsn, active, synced, invalidation) with retained and unconfirmed bytes and
    whether a standby's copy may be promoted."""
    usable = F.coalesce(F.col("synced") & F.col("invalidation").isNull(), F.lit(False))
    return slots.select("name", (F.col("current_lsn") - F.col("restart_lsn")).alias("retained"), (F.col("current_lsn") - F.col("confirmed_lsn")).alias("unconfirmed"), "active", usable.alias("promotable"))


def source_overview(status: DataFrame, health: DataFrame) -> DataFrame:
    """Source status with its slot's health, if known."""
    return status.join(health, status["source"] == health["name"], "left").drop("name")


def caught_up(positions: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """caught_up: no sink has anything pending, and each is running if states (sink_id, state) are given."""
    idle = F.col("pending_lsn").isNull()
    if states is not None:
        positions = positions.join(states.select("sink_id", "state"), "sink_id", "left")
        idle = idle & F.coalesce(F.col("state") == "Running", F.lit(False))
    return positions.agg(F.coalesce(F.bool_and(idle), F.lit(False)).alias("caught_up"))


def version_breaks(applied: DataFrame) -> DataFrame:
    """key, versions, breaks: how many of a row's applied versions (key, n: order of application, version) are not one more
    than the one before; the first must be 1."""
    step = F.col("version") - F.lag("version", 1, 0).over(W.partitionBy("key").orderBy("n"))
    return applied.withColumn("step", step).groupBy("key").agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("step") != 1).alias("breaks"))


def merged_feed(live: DataFrame, history: DataFrame) -> DataFrame:
    """Live entries and those of the history that are not among them, by time and key."""
    return live.unionByName(history.join(live.select("at_ms", "key"), ["at_ms", "key"], "left_anti"))
