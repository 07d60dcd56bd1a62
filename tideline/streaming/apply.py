"""Structured Streaming: capture of transactions into the outbox, and folding of the outbox into row state.

All jobs work in foreachBatch. A micro-batch may be given again after a failure: the outbox replaces the batch of the same
number, and folding a batch twice leaves a state as it is, so either repeat has no effect. Nothing has a watermark: a late
change is judged by its version, never dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.functions.hlc import stamp_transactions
from tideline.operators.capture import as_outbox_rows, drop_resent, identities, masked, split_key_changes, with_changed_columns
from tideline.operators.keystate import VERSION, fold_changes, merge_parts
from tideline.operators.outbox import append_batch, stored_rows
from tideline.sources.change_log import KEY_COLUMNS, decode_messages, refuse_if_behind

STATE_SCHEMA = f"key string, delete_version {VERSION}, newest_version {VERSION}, newest_image array<struct<name:string,value:string>>, registers array<struct<column:string,version:{VERSION},value:string>>"
POSITIONS = "source string, confirmed_lsn long, last_hlc long"


def capture_stream(changes: DataFrame, outbox: str, checkpoint: str, owned: dict[str, int] | None = None, **trigger) -> StreamingQuery:
    """Stores each micro-batch of changes before it counts as read; owned: see append_batch."""
    writer = changes.writeStream.foreachBatch(lambda batch, number: append_batch(batch, outbox, number, owned))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass
class CaptureSession:
    """Transactions (source, txn, commit_lsn, end_lsn, wall_ms, commit_ms, messages) to an outbox, micro-batch by micro-batch:
    resent ones are dropped, messages decoded, key changes split, changed columns named, clocks stamped from where the last
    batch ended, images masked, ids given and all of it stored, images as JSON. Positions go to a table beside the changes, under the batch's number and
    after them; a batch that is given again starts from the positions before it. Within a source, transactions come in commit
    order from batch to batch."""

    spark: SparkSession
    outbox: str
    owned: dict[str, int] | None = None
    merge_tables: list[str] = field(default_factory=list)
    masks: dict[str, dict[str, str]] = field(default_factory=dict)
    key_columns: list[str] = field(default_factory=lambda: list(KEY_COLUMNS))
    secret: bytes = b""

    def positions(self, before: int | None = None) -> DataFrame:
        """POSITIONS after the batches with a number below `before` (all): a row a source."""
        stored = stored_rows(self.spark, f"{self.outbox}/_positions", f"{POSITIONS}, batch long")
        if before is not None:
            stored = stored.where(F.col("batch") < before)
        return stored.groupBy("source").agg(F.max("confirmed_lsn").alias("confirmed_lsn"), F.max("last_hlc").alias("last_hlc"))

    def changes(self, txns: DataFrame, stored: DataFrame) -> DataFrame:
        """The outbox rows of new transactions."""
        stamped = stamp_transactions(txns.select("source", "commit_lsn", "wall_ms", "commit_ms"), stored).select("source", "commit_lsn", "hlc", "commit_ms")
        decoded = decode_messages(txns, key_columns=self.key_columns).where("op is not null")
        split = split_key_changes(decoded.drop("moved"))
        named = with_changed_columns(split, self.merge_tables).join(stamped, ["source", "commit_lsn"])
        shown = identities(masked(named, self.masks, {t: self.key_columns for t in self.masks}, self.secret))
        return as_outbox_rows(shown.select("source", "txn", "commit_lsn", "ordinal", "hlc", "commit_ms", "event_id", "entity_key", "table_name", "op", "key", "before", "after", "columns"))

    def store(self, txns: DataFrame, number: int) -> None:
        stored = self.positions(number)
        fresh = drop_resent(txns, stored)
        append_batch(self.changes(fresh, stored.select("source", "last_hlc")), self.outbox, number, self.owned)
        stamped = stamp_transactions(fresh.select("source", "commit_lsn", "end_lsn", "wall_ms"), stored.select("source", "last_hlc"))
        ends = stamped.groupBy("source").agg(F.max("end_lsn").alias("confirmed_lsn"), F.max("hlc").alias("last_hlc"))
        ends.write.mode("overwrite").parquet(f"{self.outbox}/_positions/batch={number}")

    def start(self, txns: DataFrame, checkpoint: str, available: DataFrame | None = None, **trigger) -> StreamingQuery:
        """available: the log (source, end_lsn) as it can be read now; a session is not started on one that ends before what is
        stored."""
        if available is not None:
            refuse_if_behind(available, self.positions())
        writer = txns.writeStream.foreachBatch(self.store)
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class StateTable:
    """Row state in one folder: what each micro-batch folds to, under the batch's number, so a batch writes no more than the
    rows it meets. A state is read as the merge of all batches' parts; compact() merges the parts of earlier batches into one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _parts(self) -> DataFrame:
        """The last merged part, if any, and those of the batches after it."""
        parts = stored_rows(self.spark, f"{self.path}/parts", f"{STATE_SCHEMA}, batch long")
        merged = stored_rows(self.spark, f"{self.path}/merged", f"{STATE_SCHEMA}, batch long")
        last = merged.agg(F.max("batch").alias("batch")).first().batch
        return parts if last is None else parts.where(F.col("batch") > last).unionByName(merged.where(F.col("batch") == last))

    def read(self) -> DataFrame:
        return merge_parts(self._parts())

    def fold(self, batch: DataFrame, number: int) -> None:
        fold_changes(batch).write.mode("overwrite").parquet(f"{self.path}/parts/batch={number}")

    def compact(self, upto: int) -> None:
        """Merges all batches up to a number, which must have been folded and not come again; their parts may then be removed."""
        merge_parts(self._parts().where(F.col("batch") <= upto)).write.mode("overwrite").parquet(f"{self.path}/merged/batch={upto}")


def apply_stream(changes: DataFrame, table: StateTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Folds each micro-batch of stored changes into the state table."""
    writer = changes.writeStream.foreachBatch(lambda batch, number: table.fold(batch, number))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def files_of(log: DataFrame, path: str, parts: int, order: str = "seq") -> str:
    """Writes a log as the files that a stream reads, for tests and demonstrations."""
    log.repartitionByRange(parts, F.col(order)).write.mode("overwrite").parquet(path)
    return path
