"""Queries over counters, lags, rates, feeds and checks, and the streaming apply job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.rules import show_ago, show_bytes, show_conflict, show_count, show_duration, show_key, show_rate, sink_state
from tideline.operators import stats
from tideline.operators.capture import identities
from tideline.operators.keystate import cells, conflicts, materialize, outcomes
from tideline.operators.outbox import checkpoint_reached, positions, shared_dir
from tideline.plans.delivery_queries import _cursors
from tideline.plans.sql import over_log
from tideline.sources.change_log import change_log, read_events, transactions
from tideline.streaming.apply import StateTable, apply_stream, files_of



def one_decimal(x: str) -> str:
    """SQL of a number with separators of thousands and one decimal, which is left out if it is 0."""
    return f"regexp_replace(format('{{:,.1f}}', round({x}, 1)), '[.]0$', '')"


#: Delivery time of a change in the examples: up to 2 s after its commit.
LAG_SQL = "(seq * 7919) % 2000"


def capture_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.capture_counters(change_log(spark, sf_dir), transactions(read_events(spark, sf_dir)))


CAPTURE_SQL = over_log("SELECT source, count(*) AS changes, count(DISTINCT txn) AS txns, max(commit_ms) AS last_commit_ms FROM lg GROUP BY source")


def lag_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.lag_summary(change_log(spark, sf_dir), F.expr(LAG_SQL))


PERCENTILE_SQL = over_log(f"""SELECT source, count(*) AS n, CAST(round(quantile_cont({LAG_SQL}, 0.5)) AS BIGINT) AS p50, CAST(round(quantile_cont({LAG_SQL}, 0.95)) AS BIGINT) AS p95,
  CAST(round(quantile_cont({LAG_SQL}, 0.99)) AS BIGINT) AS p99, max({LAG_SQL}) AS most FROM lg GROUP BY source""")


def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nearest_rank(change_log(spark, sf_dir).select("key", F.expr(LAG_SQL).alias("lag")), "lag", ["key"], 0.95)


NEAREST_SQL = over_log(f"""SELECT key, lag AS nearest FROM (SELECT key, {LAG_SQL} AS lag, row_number() OVER (PARTITION BY key ORDER BY {LAG_SQL}) AS p, count(*) OVER (PARTITION BY key) AS n FROM lg)
WHERE p = greatest(1, ceil(0.95 * n))""")


def sink_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    now = log.agg(F.max("commit_ms")).first()[0]
    lags = stats.sink_lags(positions(log, _cursors(spark, log)), F.lit(now))
    state = sink_state(F.col("sink_id") == "search", F.col("sink_id") == "none", F.col("lag_ms") > 0)
    return lags.select("sink_id", "source", "lag_ms", state.alias("state"), show_duration(F.col("lag_ms")).alias("shown"))


_LAGS = """(SELECT sink_id, cu.source, coalesce(greatest(0, (SELECT max(commit_ms) FROM lg) - arg_min(commit_ms, seq) FILTER (seq > last_seq)), 0) AS lag_ms FROM cu JOIN lg ON cu.source = lg.source GROUP BY sink_id, cu.source)"""
STATUS_SQL = over_log(f"""SELECT sink_id, source, lag_ms, CASE WHEN sink_id = 'search' THEN 'Rebuilding' WHEN lag_ms > 0 THEN 'Retrying' ELSE 'Running' END AS state,
  CASE WHEN lag_ms < 1000 THEN lag_ms || ' ms' WHEN lag_ms < 60000 THEN {one_decimal('lag_ms / 1000.0')} || ' s' ELSE {one_decimal('lag_ms / 60000.0')} || ' min' END AS shown FROM {_LAGS}""")


def worst_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    now = log.agg(F.max("commit_ms")).first()[0]
    return stats.worst_lags(stats.sink_lags(positions(log, _cursors(spark, log)), F.lit(now)))


WORST_SQL = over_log(f"SELECT sink_id, max(lag_ms) AS lag_ms FROM {_LAGS} GROUP BY sink_id")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly running counts per source that start anew every 24 hours."""
    hours = change_log(spark, sf_dir).groupBy("source", F.expr("commit_ms div 3600000").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.select(F.col("source").alias("name"), (F.col("hour") * 3600000).alias("at_ms"), (F.col("n") * 3600 * (F.col("hour") % 24 + 1)).alias("total"))


_SAMPLES = "(SELECT source AS name, commit_ms // 3600000 * 3600000 AS at_ms, count(*) * 3600 * (commit_ms // 3600000 % 24 + 1) AS total FROM lg GROUP BY source, commit_ms // 3600000)"


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.throughput(_samples(spark, sf_dir))


THROUGHPUT_SQL = over_log(f"""SELECT name, at_ms, CAST(CASE WHEN s IS NULL OR s <= 0 OR g < 0 THEN 0 ELSE g * 1000 // s END AS BIGINT) AS per_second FROM (
  SELECT *, at_ms - lag(at_ms) OVER w AS s, total - lag(total) OVER w AS g FROM {_SAMPLES} WINDOW w AS (PARTITION BY name ORDER BY at_ms))""")


def lag_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latest(_samples(spark, sf_dir), "name", ["at_ms"], 60).select("name", "at_ms", "total", show_count(F.col("total")).alias("shown"))


HISTORY_SQL = over_log(f"""SELECT name, at_ms, total, format('{{:,}}', total) AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY at_ms DESC) AS p FROM {_SAMPLES}) WHERE p <= 60""")


def feed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five changes per source and ten hours: commits are far apart, so their clock is slowed to that many a second."""
    log = change_log(spark, sf_dir).withColumn("commit_ms", F.expr("commit_ms div 36000"))
    return stats.sampled_feed(log).select("source", "second", "seq")


FEED_SQL = over_log("""SELECT source, second, seq FROM (SELECT source, commit_ms // 36000 // 1000 AS second, seq, row_number() OVER (PARTITION BY source, commit_ms // 36000 // 1000 ORDER BY seq) AS p FROM lg) WHERE p <= 5""")


def recent_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latest(change_log(spark, sf_dir).select("op", "seq", "key"), "op", ["seq"], 200).select("op", "seq", "key")


RECENT_SQL = over_log("SELECT op, seq, key FROM (SELECT op, seq, key, row_number() OVER (PARTITION BY op ORDER BY seq DESC) AS p FROM lg) WHERE p <= 200")


def ordering_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows applied in the order of their clocks instead of the log's."""
    applied = change_log(spark, sf_dir).select("key", "seq", F.struct("hlc", "source", "ordinal").alias("n"))
    return stats.inversions(applied)


INVERSION_SQL = over_log("SELECT count(*) FILTER (seq < p) AS inversions FROM (SELECT seq, lag(seq) OVER (PARTITION BY key ORDER BY v) AS p FROM lg)")


def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.table_digest(change_log(spark, sf_dir), "key", "seq", ["seq", "op", "cents"])


DIGEST_SQL = over_log("""SELECT key, md5(string_agg(d, ',' ORDER BY p)) AS digest FROM (
  SELECT key, seq // 1000 AS p, md5(string_agg(l, ',' ORDER BY l)) AS d FROM (SELECT key, seq, md5(concat_ws('|', CAST(seq AS VARCHAR), op, coalesce(CAST(cents AS VARCHAR), '~'))) AS l FROM lg) GROUP BY key, seq // 1000) GROUP BY key""")


def lost_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes acknowledged up to the end against a store that missed one source's last transactions."""
    log = change_log(spark, sf_dir)
    latest = lambda rows: rows.groupBy("key").agg(F.max("seq").alias("seq"))
    return stats.lost_writes(latest(log), latest(log.where("source <> 'us' or seq % 10 < 7")))


LOST_SQL = over_log("""SELECT count(*) FILTER (s IS NULL OR s < a) AS lost FROM (SELECT key, max(seq) AS a, max(seq) FILTER (source <> 'us' OR seq % 10 < 7) AS s FROM lg GROUP BY key)""")


def slot_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source counters with the health of each one's slot."""
    log = change_log(spark, sf_dir)
    slots = log.groupBy(F.col("source").alias("name")).agg(F.max("end_lsn").alias("current_lsn"), F.min("commit_lsn").alias("restart_lsn"), F.max("commit_lsn").alias("confirmed_lsn"))
    slots = slots.withColumns({"active": F.col("name") == "eu", "synced": F.lit(True), "invalidation": F.when(F.col("name") == "us", F.lit("wal_removed"))})
    return stats.source_overview(stats.capture_counters(log, transactions(read_events(spark, sf_dir))).select("source", "changes"), stats.slot_health(slots))


HEALTH_SQL = over_log("""SELECT source, count(*) AS changes, max(end_lsn) - min(commit_lsn) AS retained, max(end_lsn) - max(commit_lsn) AS unconfirmed, source = 'eu' AS active, source <> 'us' AS promotable FROM lg GROUP BY source""")


def all_caught_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    return stats.caught_up(positions(log, _cursors(spark, log)))


CAUGHT_SQL = over_log("SELECT bool_and(p IS NULL) AS caught_up FROM (SELECT min(commit_lsn) FILTER (seq > last_seq) AS p FROM cu JOIN lg ON cu.source = lg.source GROUP BY sink_id, cu.source)")


def live_and_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed whose live part overlaps its history."""
    rows = change_log(spark, sf_dir).select(F.col("commit_ms").alias("at_ms"), F.concat_ws("-", "key", "seq").alias("key"))
    feed = rows.withColumn("n", F.split_part("key", F.lit("-"), F.lit(2)).cast("long"))
    return stats.merged_feed(feed.where("n % 3 <> 0").drop("n"), feed.where("n % 2 = 0").drop("n"))


LIVE_SQL = over_log("SELECT commit_ms AS at_ms, key || '-' || seq AS key FROM lg WHERE seq % 3 <> 0 OR seq % 2 = 0")


def version_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that rise by one with each change of a row, of which some were never applied."""
    place = F.row_number().over(W.partitionBy("key").orderBy("seq"))
    applied = change_log(spark, sf_dir).select("key", F.col("seq").alias("n"), place.alias("version")).where("n % 97 <> 5")
    return stats.version_breaks(applied)


BREAKS_SQL = over_log("""SELECT key, count(*) AS versions, count(*) FILTER (version - p <> 1) AS breaks FROM (
  SELECT key, version, lag(version, 1, 0) OVER (PARTITION BY key ORDER BY seq) AS p FROM (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS version FROM lg) WHERE seq % 97 <> 5) GROUP BY key""")


def checkpoints_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any source has got to a position: one that all have, one that only the last transaction has, one past the end."""
    stored = transactions(read_events(spark, sf_dir)).groupBy("source").agg(F.max("end_lsn").alias("confirmed_lsn"))
    last = stored.agg(F.max("confirmed_lsn")).first()[0]
    found = [checkpoint_reached(stored, F.lit(x)).withColumn("lsn", F.lit(x).cast("long")) for x in (10_000, last, last + 1)]
    return found[0].unionByName(found[1]).unionByName(found[2])


REACHED_SQL = over_log("""SELECT lsn, (SELECT bool_or(c >= lsn) FROM (SELECT max(end_lsn) AS c FROM tx GROUP BY source)) AS reached
FROM (SELECT unnest([10000, max(end_lsn), max(end_lsn) + 1]) AS lsn FROM tx)""")


def running_and_caught_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sinks at the head are caught up when all run, and when one has stopped."""
    log = change_log(spark, sf_dir)
    ends = _cursors(spark, log).select("sink_id", "source").join(log.groupBy("source").agg(F.max("seq").alias("last_seq")), "source")
    at = positions(log, ends)
    states = ends.select("sink_id").distinct().withColumn("state", F.lit("Running"))
    stopped = states.withColumn("state", F.when(F.col("sink_id") == "hook", "Stopped").otherwise("Running"))
    return stats.caught_up(at, states).withColumn("case", F.lit("running")).unionByName(stats.caught_up(at, stopped).withColumn("case", F.lit("one stopped")))


RUNNING_SQL = over_log("""SELECT c."case", c.running AND (SELECT count(*) = 0 FROM lg JOIN (SELECT source, max(seq) AS m FROM lg GROUP BY source) h ON lg.source = h.source WHERE seq > m) AS caught_up
FROM (VALUES ('running', true), ('one stopped', false)) c("case", running)""")


def feed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a feed on lost changes, with their rows' keys."""
    rows = identities(change_log(spark, sf_dir)).select("seq", "source", "hlc", "ordinal", F.substring_index("entity_key", " ", -1).alias("document"))
    lost = conflicts(outcomes(change_log(spark, sf_dir))).select("seq", F.struct(F.col("winner_source").alias("source"), F.col("winner_hlc").alias("hlc"), F.col("winner_ordinal").alias("ordinal")).alias("winner"))
    return rows.join(lost, "seq").select("seq", show_key(F.col("document")).alias("key"), show_conflict(F.col("winner"), F.col("source"), F.col("hlc"), F.col("ordinal")).alias("detail"))


FEED_TEXT_SQL = over_log("""SELECT oc.seq, 'id=' || oc.key AS key, 'kept ' || split_part(winner, '/', 2) || ' at ' || CAST(split_part(winner, '/', 1) AS BIGINT) || '/' || CAST(split_part(winner, '/', 3) AS BIGINT)
  || ' over ' || lg.source || ' at ' || lg.hlc || '/' || lg.ordinal AS detail FROM oc JOIN lg ON oc.seq = lg.seq WHERE NOT changed AND split_part(winner, '/', 2) <> oc.source""")


def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as a console shows them. Sizes leave the range of a long from event 90,741 on, so they are decimals."""
    n = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    wide = n.cast("decimal(38,0)")
    size = F.when(n % 10 != 3, wide * wide * wide * 12345)
    at = F.when(n % 11 != 3, F.lit(10_000_000) - n * n)
    return rows.select("event_id", show_count(n * 7919).alias("count"), show_rate(n / 8).alias("rate"), show_duration(n * 100 + 37).alias("duration"), show_bytes(size).alias("bytes"), show_ago(at, F.lit(10_000_000)).alias("ago"))


_BYTES = "event_id * event_id * event_id * 12345"
FORMAT_SQL = f"""SELECT event_id, format('{{:,}}', event_id * 7919) AS count,
  CASE WHEN event_id >= 80 THEN format('{{:,}}', CAST(round(event_id / 8) AS BIGINT)) ELSE {one_decimal('event_id / 8')} END || '/s' AS rate,
  CASE WHEN event_id * 100 + 37 < 1000 THEN event_id * 100 + 37 || ' ms' WHEN event_id * 100 + 37 < 60000 THEN {one_decimal('(event_id * 100 + 37) / 1000')} || ' s' ELSE {one_decimal('(event_id * 100 + 37) / 60000')} || ' min' END AS duration,
  CASE WHEN event_id % 10 = 3 THEN 'unknown' WHEN {_BYTES} < 1024 THEN {_BYTES} || ' B' WHEN {_BYTES} < 1048576 THEN {one_decimal(f'{_BYTES} / 1024')} || ' KiB'
    WHEN {_BYTES} < 1073741824 THEN {one_decimal(f'{_BYTES} / 1048576')} || ' MiB' WHEN {_BYTES} < 1099511627776 THEN {one_decimal(f'{_BYTES} / 1073741824')} || ' GiB' ELSE {one_decimal(f'{_BYTES} / 1099511627776')} || ' TiB' END AS bytes,
  CASE WHEN event_id % 11 = 3 THEN 'never' WHEN s < 60 THEN s || ' s ago' WHEN s < 3600 THEN CAST(round(s / 60) AS BIGINT) || ' min ago' ELSE CAST(round(s / 3600) AS BIGINT) || ' h ago' END AS ago
FROM (SELECT event_id, CAST(round(event_id * event_id / 1000) AS BIGINT) AS s FROM events)"""


def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current cells after the log went through the streaming apply job in several micro-batches; equals merge_current."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = files_of(change_log(spark, sf_dir), f"{folder}/log", 4)
    schema = spark.read.parquet(source).schema
    table = StateTable(spark, f"{folder}/state")
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    apply_stream(changes, table, f"{folder}/checkpoint").awaitTermination()
    return cells(materialize(table.read()))


STREAM_SQL = over_log("SELECT key, name AS column, value FROM mg")

QUERIES = {
    "capture_counters": (capture_counters, CAPTURE_SQL),
    "lag_percentiles": (lag_percentiles, PERCENTILE_SQL),
    "nearest_rank": (nearest_rank, NEAREST_SQL),
    "sink_status": (sink_status, STATUS_SQL),
    "worst_lag": (worst_lag, WORST_SQL),
    "throughput": (throughput, THROUGHPUT_SQL),
    "lag_history": (lag_history, HISTORY_SQL),
    "feed_sample": (feed_sample, FEED_SQL),
    "recent_feed": (recent_feed, RECENT_SQL),
    "ordering_inversions": (ordering_inversions, INVERSION_SQL),
    "table_digest": (table_digest, DIGEST_SQL),
    "lost_acks": (lost_acks, LOST_SQL),
    "slot_health": (slot_health, HEALTH_SQL),
    "caught_up": (all_caught_up, CAUGHT_SQL),
    "live_and_history": (live_and_history, LIVE_SQL),
    "stream_apply": (stream_apply, STREAM_SQL),
    "version_breaks": (version_breaks, BREAKS_SQL),
    "checkpoint_reached": (checkpoints_reached, REACHED_SQL),
    "running_and_caught_up": (running_and_caught_up, RUNNING_SQL),
    "feed_text": (feed_text, FEED_TEXT_SQL),
    "display_formats": (display_formats, FORMAT_SQL),
}
