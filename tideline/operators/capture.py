"""From decoded transactions to stamped, masked changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.images import changed_columns, to_image_json
from tideline.functions.lsn import lsn_format
from tideline.functions.masks import check_key_masks, mask_image


def drop_resent(txns: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Transactions past their source's stored position, each once. Positions, a row a source, are broadcast: a shuffle by source
    would make a source one task's, here and in all that follows in its partitions."""
    known = txns.join(F.broadcast(checkpoints.select("source", "confirmed_lsn")), "source", "left")
    fresh = known.where(F.col("end_lsn") > F.coalesce("confirmed_lsn", F.lit(0))).drop("confirmed_lsn")
    return fresh.dropDuplicates(["source", "commit_lsn"])


def resent_counts(txns: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """source, resent: transactions that were stored before."""
    known = txns.join(F.broadcast(checkpoints.select("source", "confirmed_lsn")), "source")
    return known.groupBy("source").agg(F.count_if(F.col("end_lsn") <= F.col("confirmed_lsn")).alias("resent"))


def split_key_changes(changes: DataFrame) -> DataFrame:
    """Changes (source, commit_lsn, ordinal, op, key, previous_key, before, after) with an update of the key turned into a
    delete of the old key and an insert of the new one, and ordinals given anew from 0 in the transaction."""
    moved = (F.col("op") == "u") & F.col("previous_key").isNotNull() & ~F.col("previous_key").eqNullSafe(F.col("key"))
    part = lambda op, key, before, after, moved: F.struct(F.lit(op).alias("op") if isinstance(op, str) else op.alias("op"), key.alias("key"), before.alias("before"), after.alias("after"), F.lit(moved).alias("moved"))
    before, after, key = F.col("before"), F.col("after"), F.col("key")
    parts = F.when(moved, F.array(part("d", F.col("previous_key"), before, _null_like(after), True), part("c", key, _null_like(before), after, True)))
    parts = parts.otherwise(F.array(part(F.col("op"), key, before, after, False)))
    keep = [c for c in changes.columns if c not in ("op", "key", "previous_key", "before", "after", "ordinal")]
    wide = changes.select(*keep, F.col("ordinal").alias("old_ordinal"), F.posexplode(parts).alias("part_no", "part"))
    ordinal = F.row_number().over(W.partitionBy("source", "commit_lsn").orderBy("old_ordinal", "part_no")) - 1
    return wide.select(*keep, ordinal.alias("ordinal"), "part.*")


def _null_like(col: Column) -> Column:
    return F.when(F.lit(False), col)


def with_changed_columns(changes: DataFrame, merge_tables: list[str]) -> DataFrame:
    """columns: for updates of merge tables the names that changed, else null (all). Taken before masking."""
    merged = (F.col("op") == "u") & F.col("table_name").isin(merge_tables)
    return changes.withColumn("columns", F.when(merged, changed_columns(F.col("before"), F.col("after"))))


def masked(changes: DataFrame, policies: dict[str, dict[str, str]], key_columns: dict[str, list[str]], secret: bytes) -> DataFrame:
    """key_image, before and after masked by table; tables without a policy pass unchanged."""
    for table, masks in policies.items():
        check_key_masks(masks, key_columns.get(table, []))
    out = {}
    for column in ("key_image", "before", "after"):
        if column in changes.columns:
            value = F.col(column)
            for table, masks in sorted(policies.items()):
                value = F.when(F.col("table_name") == table, mask_image(F.col(column), masks, secret)).otherwise(value)
            out[column] = value
    return changes.withColumns(out)


def identities(changes: DataFrame) -> DataFrame:
    """entity_key (table and key document), event_id (source/position/ordinal); a snapshot row's id ends with its key, as all
    of a snapshot share one position. key is an image, or the text of a key column "id"."""
    is_image = changes.schema["key"].dataType.typeName() == "array"
    document = to_image_json(F.col("key") if is_image else F.array(F.struct(F.lit("id").alias("name"), F.col("key").alias("value"))))
    own = document if is_image else F.col("key")
    event = F.concat_ws("/", "source", lsn_format(F.col("commit_lsn")), F.col("ordinal").cast("string"), F.when(F.col("hlc") == 0, own))
    return changes.withColumns({"entity_key": F.concat("table_name", F.lit(" "), document), "event_id": event})


def snapshot_changes(rows: DataFrame, source: str) -> DataFrame:
    """Rows (table_name, key, after) as inserts of the lowest version: clock 0, position 0, ordinal 0."""
    zero = {"commit_lsn": F.lit(0).cast("long"), "hlc": F.lit(0).cast("long"), "ordinal": F.lit(0), "commit_ms": F.lit(0).cast("long")}
    return rows.withColumns({"source": F.lit(source), "op": F.lit("c"), "columns": F.lit(None).cast("array<string>"), **zero})


def _batches_after(sizes: np.ndarray, max_changes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sizes summed up; and for each transaction, and past the last: how many batches close from there to the end if one begins
    there, and how many changes are in the open one then."""
    upto = np.cumsum(sizes)
    n = len(sizes)
    closes = np.searchsorted(upto, np.concatenate(([0], upto[:-1])) + max_changes)  # the transaction that closes a batch begun here
    closed, open_ = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    for k in range(n - 1, -1, -1):
        if closes[k] < n:
            closed[k], open_[k] = closed[closes[k] + 1] + 1, open_[closes[k] + 1]
        else:
            open_[k] = upto[-1] - upto[k] + sizes[k]
    return upto, closed, open_


def commit_groups(txns: DataFrame, max_changes: int = 2000, lsns_per_range: int = 1_000_000) -> DataFrame:
    """batch: whole transactions (source, commit_lsn, n_changes) of a source in commit order; a batch closes with the
    transaction that brings it to max_changes or more, so no transaction is split.

    Where a batch begins depends on all before it, so a range of log positions is first described by what it makes of every
    number of changes that may be open at its start (steps, as most numbers come to the same), these descriptions are
    followed from range to range, and then each range is numbered from what is open at its start."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in txns.schema)
    ranged = txns.withColumn("lsn_range", F.floor(F.col("commit_lsn") / lsns_per_range))
    source = txns.schema["source"].dataType.simpleString()

    def describe(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame.sort_values("commit_lsn")["n_changes"].to_numpy(np.int64)
        upto, closed, open_ = _batches_after(sizes, max_changes)
        held = np.arange(max_changes)
        first = np.searchsorted(upto, max_changes - held)  # the transaction that closes the batch that is open
        inside = first < len(sizes)
        after = np.minimum(first + 1, len(sizes))
        found = pd.DataFrame({"held": held, "closed": np.where(inside, 1 + closed[after], 0), "left": np.where(inside, open_[after], held + upto[-1]), "adds": ~inside})
        # numbers that come to the same follow each other; where nothing closes, what is held goes on
        shift = found["left"] - np.where(found["adds"], found["held"], 0)
        steps = found[(found["closed"].diff() != 0) | (shift.diff() != 0) | (found["adds"] != found["adds"].shift())]
        return pd.DataFrame({"source": keys[0], "lsn_range": keys[1], "held": [steps["held"].tolist()], "closed": [steps["closed"].tolist()], "left": [steps["left"].tolist()], "adds": [steps["adds"].tolist()]})

    def follow(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lsn_range")
        batch = held = 0
        rows = []
        for part, froms, closed, left, adds in frame[["lsn_range", "held", "closed", "left", "adds"]].itertuples(index=False):
            rows.append((keys[0], part, batch, held))
            k = int(np.searchsorted(froms, held, side="right")) - 1
            batch, held = batch + int(closed[k]), int(left[k]) + (held - int(froms[k]) if adds[k] else 0)
        return pd.DataFrame(rows, columns=["source", "lsn_range", "first_batch", "held"])

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("commit_lsn")
        batch, held = int(frame["first_batch"].iloc[0]), int(frame["held"].iloc[0])
        batches = []
        for size in frame["n_changes"].tolist():
            batches.append(batch)
            held += size
            if held >= max_changes:
                batch, held = batch + 1, 0
        return frame.drop(columns=["lsn_range", "first_batch", "held"]).assign(batch=batches)

    steps = "held array<long>, closed array<long>, left array<long>, adds array<boolean>"
    described = ranged.select("source", "lsn_range", "commit_lsn", "n_changes").groupBy("source", "lsn_range").applyInPandas(describe, f"source {source}, lsn_range long, {steps}")
    begins = described.groupBy("source").applyInPandas(follow, f"source {source}, lsn_range long, first_batch long, held long")
    placed = ranged.join(begins, ["source", "lsn_range"]).select(*txns.columns, "lsn_range", "first_batch", "held")
    return placed.groupBy("source", "lsn_range").applyInPandas(number, f"{schema}, batch long")


def as_outbox_rows(changes: DataFrame) -> DataFrame:
    """The stored form: key, before and after as JSON text in column order."""
    stored = {c: F.when(F.col(c).isNotNull(), to_image_json(F.col(c))) for c in ("key", "before", "after") if changes.schema[c].dataType.typeName() == "array"}
    return changes.withColumns(stored)
