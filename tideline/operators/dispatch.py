"""Delivery to sinks: lanes, progress, parking, retries, start positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.outbox import last_seq_before


def lane(key: Column, lanes: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")


def in_lanes(changes: DataFrame, lanes: int, key: str = "key") -> DataFrame:
    """Changes dealt by row, in order within each row."""
    return changes.repartition(lanes, key).sortWithinPartitions(key, "seq")


def marks(progress: DataFrame, start: int = 0) -> DataFrame:
    """source, mark, in_flight from dispatched changes (source, seq, finished): the greatest seq below every unfinished one."""
    open_ = progress.groupBy("source").agg(F.min(F.when(~F.col("finished"), F.col("seq"))).alias("open"), F.count_if(~F.col("finished")).alias("in_flight"))
    below = F.max(F.when(F.col("open").isNull() | (F.col("seq") < F.col("open")), F.col("seq")))
    found = progress.join(open_, "source").groupBy("source").agg(below.alias("mark"), F.first("in_flight").alias("in_flight"))
    return found.select("source", F.coalesce("mark", F.lit(start)).alias("mark"), "in_flight")


def parked(changes: DataFrame, refused: Column, blocked: DataFrame | None = None) -> DataFrame:
    """Changes with `parked`: a refused change parks itself and all later changes of its row; rows that already have a letter
    (blocked: key) park everything."""
    first = F.min(F.when(refused, F.col("seq"))).over(W.partitionBy("key"))
    rows = changes.withColumn("first_refused", first)
    held = F.coalesce(F.col("seq") >= F.col("first_refused"), F.lit(False))
    if blocked is not None:
        rows = rows.join(blocked.select("key").distinct().withColumn("has_letter", F.lit(True)), "key", "left")
        held = held | F.coalesce("has_letter", F.lit(False))
        rows = rows.withColumn("parked", held).drop("has_letter")
    else:
        rows = rows.withColumn("parked", held)
    return rows.drop("first_refused")


def dead_letters(changes: DataFrame, refused: Column, blocked: DataFrame | None = None) -> DataFrame:
    """source, seq, key, error, attempts of the changes that are parked."""
    error = F.when(refused, "refused").otherwise("behind a refused change")
    return parked(changes, refused, blocked).where("parked").select("source", "seq", "key", error.alias("error"), F.lit(1).alias("attempts"))


def blocked_keys(letters: DataFrame) -> DataFrame:
    open_ = letters.where("resolved_at is null") if "resolved_at" in letters.columns else letters
    return open_.select("key").distinct()


def retry_letters(letters: DataFrame, still_refused: Column) -> DataFrame:
    """key, letters, resolved: a row's letters are tried in order and all or none; one refusal leaves all of them."""
    return letters.groupBy("key").agg(F.count(F.lit(1)).alias("letters"), (~F.bool_or(still_refused)).alias("resolved"))


def after_retry(letters: DataFrame, retried: DataFrame, at_ms: int) -> DataFrame:
    """Letters with resolved_at set for resolved rows and one more attempt for the others."""
    joined = letters.join(retried.select("key", "resolved"), "key", "left")
    failed = F.coalesce(~F.col("resolved"), F.lit(False))
    out = joined.withColumn("resolved_at", F.when(F.coalesce("resolved", F.lit(False)), F.lit(at_ms).cast("long")))
    return out.withColumn("attempts", F.col("attempts") + failed.cast("int")).drop("resolved")


def start_cursors(log: DataFrame, mode: str, lsn: int = 0) -> DataFrame:
    """source, last_seq, start_lsn of a new sink: from the beginning, from now, from a position, or from a snapshot taken at
    one (the change stream then starts at that position)."""
    head = F.coalesce(F.max("seq"), F.lit(0))
    earlier = F.coalesce(F.max(F.when(F.col("commit_lsn") < lsn, F.struct("commit_lsn", "seq")))["seq"], F.lit(0))
    last = {"beginning": F.lit(0), "now": head, "lsn": earlier, "snapshot": earlier}[mode]
    start = {"beginning": F.lit(0), "now": F.coalesce(F.max("commit_lsn"), F.lit(0)), "lsn": F.lit(lsn), "snapshot": F.lit(lsn)}[mode]
    return log.groupBy("source").agg(last.cast("long").alias("last_seq"), start.cast("long").alias("start_lsn"))


def advance_cursors(cursors: DataFrame, moves: DataFrame) -> DataFrame:
    """Cursors after moves (sink_id, source, last_seq); a cursor never goes back."""
    both = cursors.select("sink_id", "source", "last_seq").unionByName(moves.select("sink_id", "source", "last_seq"))
    return both.groupBy("sink_id", "source").agg(F.max("last_seq").alias("last_seq"))


def set_cursors(cursors: DataFrame, moves: DataFrame) -> DataFrame:
    """Cursors (sink_id, source, last_seq, start_lsn) with those of moves in place of the sinks' earlier ones, forward or back."""
    own = ["sink_id", "source", "last_seq", "start_lsn"]
    return cursors.select(*own).join(moves.select("sink_id", "source"), ["sink_id", "source"], "left_anti").unionByName(moves.select(*own))


def replay_cursors(log: DataFrame, sink_id: str, from_lsn: int) -> DataFrame:
    """Cursors of a sink that is to get everything from a position on again, for set_cursors."""
    return start_cursors(log, "lsn", from_lsn).select(F.lit(sink_id).alias("sink_id"), "source", "last_seq", "start_lsn")


def resume_positions(log: DataFrame, cursors: DataFrame, sinks: DataFrame) -> DataFrame:
    """sink_id, source, after_seq: where delivery goes on after a restart. A durable sink goes on from its cursor; an index is
    empty by then and starts over from the position that it was given first."""
    kept = cursors.join(sinks.select("sink_id", (F.col("kind") == "index").alias("volatile")), "sink_id")
    begins = last_seq_before(log, kept.where("volatile").select("source", F.col("start_lsn").alias("lsn")))
    begins = begins.select("source", F.col("lsn").alias("start_lsn"), F.col("seq").alias("first_seq"), F.lit(True).alias("volatile"))
    after = F.when(F.col("volatile"), F.col("first_seq")).otherwise(F.col("last_seq"))
    return kept.join(begins, ["source", "start_lsn", "volatile"], "left").select("sink_id", "source", after.alias("after_seq"))


def open_letters(letters: DataFrame, sink_id: str, key: str | None = None, limit: int = 100) -> DataFrame:
    """A sink's letters (id, sink_id, key, resolved_at, ...) that are open, of one row if key is given, the oldest first. A
    page: limit is part of the request and clamped to 1..1000."""
    found = letters.where((F.col("sink_id") == sink_id) & F.col("resolved_at").isNull())
    if key is not None:
        found = found.where(F.col("key") == key)
    return found.orderBy("id").limit(max(1, min(limit, 1000)))


def resolve_letters(letters: DataFrame, ids: DataFrame, at_ms: int) -> DataFrame:
    """letters with resolved_at set for those in ids (id)."""
    marked = letters.join(ids.select("id").distinct().withColumn("named", F.lit(True)), "id", "left")
    return marked.withColumn("resolved_at", F.when(F.col("named"), F.lit(at_ms).cast("long")).otherwise(F.col("resolved_at"))).select(*letters.columns)


def record_attempts(letters: DataFrame, ids: DataFrame, error: str) -> DataFrame:
    """letters with one more attempt and a new error for those in ids (id)."""
    marked = letters.join(ids.select("id").distinct().withColumn("named", F.lit(True)), "id", "left")
    named = F.coalesce("named", F.lit(False))
    return marked.withColumns({"attempts": F.col("attempts") + named.cast("int"), "error": F.when(named, F.lit(error)).otherwise(F.col("error"))}).select(*letters.columns)


def clear_letters(letters: DataFrame, sink_id: str) -> DataFrame:
    return letters.where(F.col("sink_id") != sink_id)


def replay(log: DataFrame, from_lsn: int) -> DataFrame:
    """The changes a sink gets again."""
    return log.where(F.col("commit_lsn") >= from_lsn)
