"""Queries over capture: decoding, stamping, key changes, changed columns, masks, positions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.hlc import hlc_counter, hlc_millis, stamp_transactions
from tideline.functions.images import entry, image, to_image_json, value_of
from tideline.functions.lsn import lsn_diff, lsn_format, lsn_parse
from tideline.functions.masks import hmac_pads, mask_image
from tideline.operators.capture import commit_groups, drop_resent, identities, resent_counts, snapshot_changes, split_key_changes, with_changed_columns
from tideline.operators.outbox import claim, read_outbox, shared_dir
from tideline.plans.sql import over_log
from tideline.sources.change_log import TABLE, change_log, decode_messages, event_image, message_transactions, read_events, snapshot_scan, sources_behind, table_columns, transactions
from tideline.streaming.apply import CaptureSession

SECRET = b"an example key of thirty-two bytes"
INNER, OUTER = hmac_pads(SECRET)


def decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode_messages(message_transactions(read_events(spark, sf_dir))).where("op is not null")
    name = lambda c: value_of(F.col(c), "id")
    carried = lambda c: F.coalesce(F.size(c), F.lit(-1)).cast("long")
    return rows.select("source", "commit_lsn", F.col("ordinal").cast("long").alias("ordinal"), "op", name("key").alias("key"), name("previous_key").alias("previous_key"), carried("before").alias("n_before"), carried("after").alias("n_after"))


DECODE_SQL = over_log("""SELECT source, commit_lsn, CAST(ordinal AS BIGINT) AS ordinal, op, key,
  CASE WHEN op = 'u' AND seq % 3 IN (0, 1) THEN key END AS previous_key,
  CAST(CASE WHEN (op = 'd' AND seq % 2 = 0) OR (op = 'u' AND seq % 3 = 0) THEN CASE WHEN seq % 5 = 0 THEN 3 ELSE 4 END ELSE -1 END AS BIGINT) AS n_before,
  CAST(CASE WHEN op = 'd' THEN -1 WHEN seq % 5 = 0 THEN 3 ELSE 4 END AS BIGINT) AS n_after
FROM ev""")


def _resent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Transactions with each source's last 20 once more, and positions stored at three fifths of them."""
    txns = transactions(read_events(spark, sf_dir))
    last = txns.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(F.col("commit_lsn").desc()))).where("place <= 20").drop("place")
    stored = txns.groupBy("source").agg((F.max("end_lsn") * 3).alias("m")).select("source", F.expr("m div 5").alias("confirmed_lsn"))
    return txns.unionByName(last), stored


def dedupe_resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_resent(*_resent(spark, sf_dir)).select("source", "commit_lsn", "end_lsn")


def resent_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resent_counts(*_resent(spark, sf_dir))


DEDUPE_SQL = over_log("SELECT source, commit_lsn, end_lsn FROM tx WHERE end_lsn > (SELECT max(end_lsn) * 3 // 5 FROM tx t WHERE t.source = tx.source)")
RESENT_SQL = over_log("""SELECT source, count(*) FILTER (end_lsn <= m) AS resent FROM (
  SELECT source, end_lsn, max(end_lsn) OVER (PARTITION BY source) * 3 // 5 AS m FROM (
    SELECT source, end_lsn FROM tx UNION ALL SELECT source, end_lsn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY commit_lsn DESC) AS p FROM tx) WHERE p <= 20))
GROUP BY source""")


def hlc_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = stamp_transactions(transactions(read_events(spark, sf_dir)), lsns_per_range=50_000)
    return stamped.select("source", "txn", "hlc", hlc_millis(F.col("hlc")).alias("millis"), hlc_counter(F.col("hlc")).alias("counter"))


HLC_SQL = over_log("SELECT source, txn, hlc, hlc >> 16 AS millis, hlc & 65535 AS counter FROM st")


def hlc_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of the second half of the log with the first half's last stamps as floors: equal to stamping all at once."""
    txns = transactions(read_events(spark, sf_dir))
    ends = txns.groupBy("source").agg(F.expr("max(commit_lsn) div 2").alias("half"))
    halves = txns.join(ends, "source")
    first = stamp_transactions(halves.where("commit_lsn <= half"))
    floors = first.groupBy("source").agg(F.max("hlc").alias("last_hlc"))
    second = stamp_transactions(halves.where("commit_lsn > half"), floors)
    return first.unionByName(second).select("source", "txn", "hlc")


HLC_RESUMED_SQL = over_log("SELECT source, txn, hlc FROM st")


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with every seventeenth update moving its row to another key."""
    moved = (F.col("seq") % 17 == 0) & (F.col("op") == "u")
    img = event_image()
    return read_events(spark, sf_dir).select("source", "commit_lsn", "ordinal", "op", "key", F.when(F.col("op") == "u", F.when(moved, F.col("other_key")).otherwise(F.col("key"))).alias("previous_key"), F.when(moved, img).alias("before"), F.when(F.col("op") != "d", img).alias("after"))


def ordinals_key_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_key_changes(_updates(spark, sf_dir)).select("source", "commit_lsn", F.col("ordinal").cast("long").alias("ordinal"), "op", "key", "moved")


KEY_CHANGE_SQL = over_log("""SELECT source, commit_lsn, row_number() OVER (PARTITION BY source, commit_lsn ORDER BY ordinal, part) - 1 AS ordinal, op, key, moved FROM (
  SELECT source, commit_lsn, ordinal, 0 AS part, 'd' AS op, other_key AS key, true AS moved FROM ev WHERE seq % 17 = 0 AND op = 'u'
  UNION ALL SELECT source, commit_lsn, ordinal, 1, 'c', key, true FROM ev WHERE seq % 17 = 0 AND op = 'u'
  UNION ALL SELECT source, commit_lsn, ordinal, 0, op, key, false FROM ev WHERE NOT (seq % 17 = 0 AND op = 'u'))""")


def changed_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed columns of updates whose row had a write before, the image of that write being the old row."""
    rows = read_events(spark, sf_dir).withColumn("after", F.when(F.col("op") != "d", event_image()))
    rows = rows.withColumn("before", F.lag("after").over(W.partitionBy("key").orderBy("seq"))).withColumn("table_name", F.lit(TABLE))
    named = with_changed_columns(rows, [TABLE]).where("columns is not null")
    return named.select("seq", F.explode("columns").alias("column"))


CHANGED_SQL = over_log("""SELECT seq, name AS column FROM (
  SELECT seq, unnest(['kind', 'cents', 'props']) AS name, op, pop, kind IS NOT DISTINCT FROM pkind AS k, cents IS NOT DISTINCT FROM pcents AS c,
    seq % 5 = 0 AS no_props, pseq % 5 <> 0 AND props IS NOT DISTINCT FROM pprops AS p
  FROM (SELECT *, lag(op) OVER w AS pop, lag(seq) OVER w AS pseq, lag(kind) OVER w AS pkind, lag(cents) OVER w AS pcents, lag(props) OVER w AS pprops
    FROM ev WINDOW w AS (PARTITION BY key ORDER BY seq)))
WHERE op = 'u' AND pop <> 'd' AND CASE name WHEN 'kind' THEN NOT k WHEN 'cents' THEN NOT c ELSE NOT no_props AND NOT p END""")


def mask_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_events(spark, sf_dir).where("op <> 'd'")
    img = image(entry("id", F.col("key")), entry("kind", F.col("kind")), entry("cents", F.when(F.col("seq") % 7 != 0, F.col("cents"))), F.when(F.col("seq") % 5 != 0, entry("props", F.col("props"))))
    shown = mask_image(img, {"id": "hash", "kind": "null", "cents": "redact", "props": "hash"}, SECRET)
    pick = lambda n: value_of(F.col("shown"), n).alias(n)
    return rows.select("seq", shown.alias("shown")).select("seq", pick("id"), pick("kind"), pick("cents"), pick("props"), F.size("shown").cast("long").alias("n_columns"))


def _hmac_sql(value: str) -> str:
    return f"sha256(unhex('{OUTER}' || sha256(unhex('{INNER}' || hex(encode({value}))))))"


MASK_SQL = over_log(f"""SELECT seq, {_hmac_sql('key')} AS id, CAST(NULL AS VARCHAR) AS kind, CASE WHEN seq % 7 <> 0 THEN '[redacted]' END AS cents,
  CASE WHEN seq % 5 <> 0 AND props IS NOT NULL THEN {_hmac_sql('props')} END AS props, CAST(CASE WHEN seq % 5 = 0 THEN 3 ELSE 4 END AS BIGINT) AS n_columns
FROM ev WHERE op <> 'd'""")


def lsn_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = (F.col("commit_lsn") * 1234567890).alias("value")
    rows = transactions(read_events(spark, sf_dir)).select("source", "txn", big, "commit_lsn")
    text = lsn_format(F.col("value"))
    return rows.select("source", "txn", text.alias("text"), lsn_parse(text).cast("long").alias("parsed"), lsn_diff(F.col("value"), F.col("commit_lsn")).alias("diff"))


LSN_SQL = over_log("""SELECT source, txn, upper(to_hex(commit_lsn * 1234567890 >> 32)) || '/' || upper(to_hex(commit_lsn * 1234567890 & 4294967295)) AS text,
  commit_lsn * 1234567890 AS parsed, commit_lsn * 1234567890 - commit_lsn AS diff FROM tx""")


def entity_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identities(change_log(spark, sf_dir)).select("seq", "entity_key", "event_id")


IDS_SQL = over_log("""SELECT seq, 'public.events {"id":"' || key || '"}' AS entity_key,
  source || '/' || upper(to_hex(commit_lsn >> 32)) || '/' || upper(to_hex(commit_lsn & 4294967295)) || '/' || ordinal AS event_id FROM lg""")


def snapshot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a snapshot: every row has the lowest version and an id of its own."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = customers.select(F.lit("public.customer").alias("table_name"), F.col("c_custkey").cast("string").alias("key"), image(entry("name", F.col("c_name"))).alias("after"))
    return identities(snapshot_changes(rows, "crm")).select("key", "event_id", "hlc", F.col("ordinal").cast("long").alias("ordinal"))


SNAPSHOT_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS key, 'crm/0/0/0/' || c_custkey AS event_id, CAST(0 AS BIGINT) AS hlc, CAST(0 AS BIGINT) AS ordinal FROM customer"


def commit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of transactions of 4 to 40 changes."""
    counted = read_events(spark, sf_dir).groupBy("source", "commit_lsn").agg((F.count(F.lit(1)) + F.max("txn") * 31 % 37).alias("n_changes"))
    return commit_groups(counted, 100, 20_000).groupBy("source", "batch").agg(F.count(F.lit(1)).alias("txns"), F.sum("n_changes").alias("changes"))


BATCH_SQL = over_log(
    "SELECT source, batch, count(*) AS txns, CAST(sum(n) AS BIGINT) AS changes FROM step GROUP BY source, batch",
    """sized AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY commit_lsn) AS i, n FROM (SELECT source, commit_lsn, count(*) + max(txn) * 31 % 37 AS n FROM ev GROUP BY source, commit_lsn)),
step(source, i, n, batch, held) AS (
  SELECT source, i, n, CAST(0 AS BIGINT), n FROM sized WHERE i = 1
  UNION ALL SELECT z.source, z.i, z.n, CASE WHEN s.held >= 100 THEN s.batch + 1 ELSE s.batch END, CASE WHEN s.held >= 100 THEN z.n ELSE s.held + z.n END
  FROM step s JOIN sized z ON z.source = s.source AND z.i = s.i + 1)""",
)


def snapshot_scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a snapshot reads them: the key's document, how many columns, and two of them as text."""
    rows = snapshot_scan(spark.read.parquet(f"{sf_dir}/customer.parquet"), "public.customer", ["c_custkey"])
    pick = lambda n: value_of(F.col("after"), n).alias(n)
    return rows.select("table_name", to_image_json(F.col("key")).alias("key"), F.size("after").cast("long").alias("n_columns"), pick("c_name"), pick("c_nationkey"))


SCAN_SQL = """SELECT 'public.customer' AS table_name, '{"c_custkey":"' || c_custkey || '"}' AS key, (SELECT count(*) FROM (DESCRIBE customer)) AS n_columns, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer"""


def table_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of lineitem, with their places in the table and in its key."""
    rows = table_columns(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])
    return spark.createDataFrame([(c, k, key or 0) for c, _, k, key in rows], "column string, position long, key_position long")


LAYOUT_SQL = """SELECT column_name AS "column", row_number() OVER () AS position, CAST(coalesce(list_position(['l_orderkey', 'l_linenumber'], column_name), 0) AS BIGINT) AS key_position FROM (DESCRIBE lineitem)"""


def behind_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which the log at hand ends before the stored position."""
    txns = transactions(read_events(spark, sf_dir))
    stored = txns.groupBy("source").agg(F.max("end_lsn").alias("confirmed_lsn"))
    return sources_behind(txns.where("source = 'eu' or end_lsn % 700 <> 10 and end_lsn < 20000"), stored)


BEHIND_SQL = over_log("""SELECT source, e AS log_end, c AS confirmed_lsn FROM (
  SELECT source, max(end_lsn) FILTER (source = 'eu' OR (end_lsn % 700 <> 10 AND end_lsn < 20000)) AS e, max(end_lsn) AS c FROM tx GROUP BY source) WHERE coalesce(e, 0) < c""")


def stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox after message transactions came in three deliveries of any number of files, of which the second and third begin
    with transactions that were in the one before, and each went through a capture session that goes on from the last."""
    events = read_events(spark, sf_dir)
    clocks = transactions(events).select("source", "txn", "wall_ms", "commit_ms")
    txns = message_transactions(events).join(clocks, ["source", "txn"])
    folder = f"{shared_dir(spark)}/capture-{uuid.uuid4().hex}"
    last = events.agg(F.max("commit_lsn")).first()[0]
    owned = {s: claim(spark, f"{folder}/outbox", s) for s in ("eu", "us")}
    session = CaptureSession(spark, f"{folder}/outbox", owned, [TABLE], {TABLE: {"kind": "redact"}}, ["id"], SECRET)
    for part in range(3):  # one after the other, in commit order; all new files are one micro-batch
        low, high = last * part // 3 - 500 * (part > 0), last * (part + 1) // 3
        txns.where((F.col("commit_lsn") > low) & (F.col("commit_lsn") <= high)).write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(txns.schema).parquet(f"{folder}/log")
        session.start(stream, f"{folder}/checkpoint", spark.read.parquet(f"{folder}/log")).awaitTermination()
    changed = F.coalesce(F.size("columns"), F.lit(-1)).cast("long")
    return read_outbox(spark, f"{folder}/outbox").select("source", "commit_lsn", F.col("ordinal").cast("long").alias("ordinal"), "op", "key", "hlc", F.get_json_object("after", "$.kind").alias("kind"), changed.alias("n_changed"))


CAPTURED_SQL = over_log("""SELECT source, commit_lsn, CAST(ordinal AS BIGINT) AS ordinal, op, '{"id":"' || key || '"}' AS key, hlc, CASE WHEN op <> 'd' THEN '[redacted]' END AS kind,
  CAST(CASE WHEN op = 'u' AND seq % 3 = 0 THEN 0 ELSE -1 END AS BIGINT) AS n_changed FROM lg""")

QUERIES = {
    "decode_events": (decode_events, DECODE_SQL),
    "dedupe_resent": (dedupe_resent, DEDUPE_SQL),
    "resent_per_source": (resent_per_source, RESENT_SQL),
    "hlc_stamp": (hlc_stamp, HLC_SQL),
    "hlc_resumed": (hlc_resumed, HLC_RESUMED_SQL),
    "ordinals_key_change": (ordinals_key_change, KEY_CHANGE_SQL),
    "changed_columns": (changed_column_names, CHANGED_SQL),
    "mask_columns": (mask_columns, MASK_SQL),
    "lsn_roundtrip": (lsn_roundtrip, LSN_SQL),
    "entity_event_ids": (entity_event_ids, IDS_SQL),
    "snapshot_ids": (snapshot_ids, SNAPSHOT_SQL),
    "commit_batches": (commit_batches, BATCH_SQL),
    "snapshot_scan": (snapshot_scan_rows, SCAN_SQL),
    "table_layout": (table_layout, LAYOUT_SQL),
    "behind_sources": (behind_sources, BEHIND_SQL),
    "stream_capture": (stream_capture, CAPTURED_SQL),
}
