"""Change logs: decoded transactions, their stamped changes, and the log derived from the `events` table.

A change log has one row per change: seq, source, txn, commit_lsn, end_lsn, ordinal, hlc, commit_ms, table_name, op
(c, u, d), key, after (image; null for deletes) and columns (names that changed; null for all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.hlc import stamp_transactions
from tideline.functions.images import entry, image, project

HEARTBEAT = "ops.heartbeat"
TABLE = "public.events"
KEY_COLUMNS = ["id"]


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw events with the fields that the derived log is defined by."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    txn = F.expr("event_id div 4")
    return raw.select(
        F.col("event_id").alias("seq"),
        txn.alias("txn"),
        (F.col("event_id") % 4).cast("int").alias("ordinal"),
        F.when(txn % 3 == 0, "us").otherwise("eu").alias("source"),
        ((txn + 1) * 100).alias("commit_lsn"),
        ((txn + 1) * 100 + 10).alias("end_lsn"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        (F.col("user_id") % 60).cast("string").alias("key"),
        ((F.col("user_id") + 1) % 60).cast("string").alias("other_key"),
        F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "signup", "c").otherwise("u").alias("op"),
        F.col("event_type").alias("kind"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        "props",
    )


def event_image() -> Column:
    """kind, cents, props; props is absent in every fifth change."""
    return image(entry("kind", F.col("kind")), entry("cents", F.col("cents")), F.when(F.col("seq") % 5 != 0, entry("props", F.col("props"))))


def transactions(events: DataFrame) -> DataFrame:
    """One row per committed transaction: its clock and its changes in order."""
    return events.groupBy("source", "txn", "commit_lsn", "end_lsn").agg(
        F.max("ms").alias("commit_ms"), (F.max("ms") - (F.first("txn") * 7919000) % 43200000).alias("wall_ms")
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    stamped = stamp_transactions(transactions(events)).select("source", "txn", "hlc", "commit_ms")
    changed = F.when(F.col("kind") == "view", F.array(F.lit("kind"))).when(F.col("kind") == "click", F.array(F.lit("cents"))).when(F.col("kind") == "purchase", F.array(F.lit("props")))
    return events.join(stamped, ["source", "txn"]).select(
        "seq", "source", "txn", "commit_lsn", "end_lsn", "ordinal", "hlc", "commit_ms", F.lit(TABLE).alias("table_name"), "op", "key",
        F.when(F.col("op") != "d", event_image()).alias("after"), changed.alias("columns"), "cents",
    )


MESSAGES = "array<struct<position:int,message:string,table_name:string,new:array<struct<name:string,value:string>>,old:array<struct<name:string,value:string>>,old_key:array<struct<name:string,value:string>>>>"


def message_transactions(events: DataFrame) -> DataFrame:
    """Transactions as a log source hands them over: arrays of row messages, with a heartbeat in every tenth and a truncate in
    every seventeenth transaction. Updates come with the full old row, the old key only, or neither, by position."""
    key = image(entry("id", F.col("key")))
    whole = F.concat(key, event_image())
    message = F.when(F.col("op") == "c", "insert").when(F.col("op") == "d", F.when(F.col("seq") % 2 == 0, "delete_full").otherwise("delete_key"))
    message = F.coalesce(message, F.when(F.col("seq") % 3 == 0, "update_full").when(F.col("seq") % 3 == 1, "update_key").otherwise("update"))
    old = F.when(message.isin("delete_full", "update_full"), whole)
    old_key = F.when(message.isin("delete_key", "update_key"), key)
    new = F.when(F.col("op") != "d", whole)
    row = F.struct(F.col("ordinal").alias("position"), message.alias("message"), F.lit(TABLE).alias("table_name"), new.alias("new"), old.alias("old"), old_key.alias("old_key"))
    txns = events.groupBy("source", "txn", "commit_lsn", "end_lsn").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    extra = lambda message, table, at: F.array(F.expr(f"named_struct('position', {at}, 'message', '{message}', 'table_name', '{table}', 'new', null, 'old', null, 'old_key', null)")).cast(MESSAGES)
    none = F.array().cast(MESSAGES)
    beat = F.when(F.col("txn") % 10 == 0, extra("update", HEARTBEAT, 4)).otherwise(none)
    cut = F.when(F.col("txn") % 17 == 0, extra("truncate", TABLE, 5)).otherwise(none)
    return txns.select("source", "txn", "commit_lsn", "end_lsn", F.concat(F.col("rows").cast(MESSAGES), beat, cut).alias("messages"))


def decode_messages(txns: DataFrame, heartbeat: str = HEARTBEAT, key_columns: list[str] = KEY_COLUMNS) -> DataFrame:
    """source, txn, commit_lsn, end_lsn, ordinal, op, key, previous_key, before, after, table_name of every row message, in order;
    row by row, so of a stream as well; heartbeats and truncates give no change, and a transaction of them alone stays as a row with op null, so its position is kept."""
    wanted = F.filter("messages", lambda m: (m["table_name"] != heartbeat) & (m["message"] != "truncate"))
    rows = txns.select("source", "txn", "commit_lsn", "end_lsn", F.posexplode_outer(wanted).alias("ordinal", "m"))
    kind = F.split_part(F.col("m.message"), F.lit("_"), F.lit(1))
    op = F.when(kind == "insert", "c").when(kind == "update", "u").when(kind == "delete", "d")
    identity = F.coalesce("m.old_key", F.when(F.col("m.old").isNotNull(), project(F.col("m.old"), key_columns)))
    key = F.when(kind == "delete", identity).otherwise(project(F.col("m.new"), key_columns))
    return rows.select(
        "source", "txn", "commit_lsn", "end_lsn", "ordinal", op.alias("op"), key.alias("key"),
        F.when(kind == "update", identity).alias("previous_key"), F.col("m.old").alias("before"), F.col("m.new").alias("after"), "m.table_name",
    )


def sources_behind(txns: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """source, log_end, confirmed_lsn of sources whose log (of which txns is the end) stops before their stored position."""
    ends = txns.groupBy("source").agg(F.max("end_lsn").alias("log_end"))
    return checkpoints.join(ends, "source", "left").where(F.coalesce("log_end", F.lit(0)) < F.col("confirmed_lsn")).select("source", "log_end", "confirmed_lsn")


def refuse_if_behind(txns: DataFrame, checkpoints: DataFrame) -> None:
    """Runs a job now, and raises ValueError if a log ends before its stored position: reading on would skip commits."""
    behind = [r.source for r in sources_behind(txns, checkpoints).select("source").limit(10).collect()]
    if behind:
        raise ValueError(f"the log ends before the stored position: {', '.join(map(str, sorted(behind)))}")


def table_columns(table: DataFrame, key_columns: list[str]) -> list[tuple[str, str, int, int | None]]:
    """(column, type, position, position in the key or None) of a table, from 1, in table order."""
    missing = sorted(set(key_columns) - set(table.columns))
    if missing:
        raise ValueError(f"no such key columns: {', '.join(missing)}")
    return [(f.name, f.dataType.simpleString(), k, key_columns.index(f.name) + 1 if f.name in key_columns else None) for k, f in enumerate(table.schema, 1)]


def snapshot_scan(table: DataFrame, table_name: str, key_columns: list[str]) -> DataFrame:
    """table_name, key (image of the key columns in key order), after (image of all columns, as text, in table order) of every
    row, for snapshot_changes."""
    columns = table_columns(table, key_columns)
    return table.select(F.lit(table_name).alias("table_name"), image(*[entry(c, F.col(c)) for c in key_columns]).alias("key"), image(*[entry(c, F.col(c)) for c, *_ in columns]).alias("after"))
