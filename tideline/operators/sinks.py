"""Sinks: typed tables, a keyword index, webhook payloads, and the catalogue of sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.images import carries, value_of
from tideline.functions.masks import hmac_pads
from tideline.functions.rules import search_tokens
from tideline.operators.ranges import with_places


def apply_to_table(base: DataFrame, rows: DataFrame, touched: DataFrame, columns: dict[str, str], whole: bool = False) -> DataFrame:
    """A table (key and columns, typed as given) after a batch: touched (key) rows are replaced by what rows (key, row) have of
    them, or removed. A column the table lacks stops the query. Columns that a row does not carry keep their value, unless rows
    are whole (as materialize gives them of the state): then they become null, as a value from before a delete would stay
    otherwise, and the table follows from the state alone, however its history was cut into batches."""
    delta = touched.select("key").distinct().join(rows, "key", "left")
    unknown = F.exists("row", lambda e: ~e["name"].isin(*columns))
    delta = delta.withColumn("row", F.when(F.coalesce(unknown, F.lit(False)), F.raise_error(F.lit("the table lacks a column")).cast("array<struct<name:string,value:string>>")).otherwise(F.col("row")))
    both = base.withColumn("in_base", F.lit(True)).join(delta.withColumn("in_delta", F.lit(True)), "key", "full")
    kept = both.where(F.col("in_delta").isNull() | F.col("row").isNotNull())
    own = lambda name: F.col("row").isNotNull() if whole else F.col("row").isNotNull() & carries(F.col("row"), name)
    cell = lambda name, kind: F.when(own(name), value_of(F.col("row"), name).cast(kind)).otherwise(F.col(name))
    return kept.select("key", *[cell(name, kind).alias(name) for name, kind in columns.items()])


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, rows: how many rows one side has and the other lacks, repeats counted."""
    count = lambda x, y, side: x.exceptAll(y).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(side).alias("side"), "rows")
    return count(a, b, "left only").unionByName(count(b, a, "right only"))


def postings(rows: DataFrame, text: Column) -> DataFrame:
    """token, key, and table_name if rows have one: the index of rows."""
    own = [c for c in ("table_name", "key") if c in rows.columns]
    return rows.select(F.explode(search_tokens(text)).alias("token"), *own).distinct()


def search(index: DataFrame, query: str, limit: int = 20, table: str | None = None) -> DataFrame:
    """Rows (key, with table_name if the index has one) that hold every token of query, by table and then key; only those of
    `table` if it is given. limit is clamped to 1..200. No token or an unknown one finds nothing."""
    spark = index.sparkSession
    own = [c for c in ("table_name", "key") if c in index.columns]
    wanted = spark.range(1).select(F.explode(search_tokens(F.lit(query))).alias("token"))
    tokens = [r.token for r in wanted.collect()]
    if not tokens:
        return index.select(*own).limit(0)
    if table is not None:
        index = index.where(F.col("table_name") == table)
    hits = index.where(F.col("token").isin(tokens)).groupBy(*own).agg(F.countDistinct("token").alias("n"))
    return hits.where(F.col("n") == len(tokens)).select(*own).orderBy(*own).limit(max(1, min(limit, 200)))


def webhook_payloads(changes: DataFrame, sink_id: str, per_payload: int = 500) -> DataFrame:
    """lane, payload_no, body: JSON documents of up to per_payload changes (lane, seq, event_id, op, key, ...) in order."""
    numbered = with_places(changes, "lane", "seq").withColumn("payload_no", F.floor((F.col("place") - 1) / per_payload)).drop("place")
    fields = ["seq", "event_id", "op", "table_name", "key", "source", "commit_lsn", "ordinal", "hlc", "after"]
    one = F.struct(*[F.col(c).alias(_camel(c)) for c in fields if c in changes.columns])
    grouped = numbered.groupBy("lane", "payload_no").agg(F.array_sort(F.collect_list(one)).alias("changes"))
    return grouped.select("lane", "payload_no", F.to_json(F.struct(F.lit(sink_id).alias("sink"), "changes"), {"ignoreNullFields": "false"}).alias("body"))


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def signature(at: Column, body: Column, key: bytes) -> Column:
    """Lower-case hex HMAC-SHA256 of time, a dot and the body."""
    inner, outer = (F.unhex(F.lit(p)) for p in hmac_pads(key))
    text = F.encode(F.concat(at.cast("string"), F.lit("."), body), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text), 256))), 256)


def sink_requests(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """new with `accepted`: false for an id that the catalogue has, and for all but one of the requests for one id (the least by
    its other columns counts)."""
    others = [c for c in new.columns if c != "sink_id"]
    taken = catalog.select("sink_id", F.lit(True).alias("taken")).distinct()
    place = F.row_number().over(W.partitionBy("sink_id").orderBy(*others) if others else W.partitionBy("sink_id").orderBy("sink_id"))
    rows = new.withColumn("place", place).join(taken, "sink_id", "left")
    return rows.withColumn("accepted", F.col("taken").isNull() & (F.col("place") == 1)).drop("place", "taken")


def add_sinks(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """The catalogue with the new sinks that sink_requests accepts."""
    return catalog.unionByName(sink_requests(catalog, new).where("accepted").select(*catalog.columns))


def remove_sink(sink_id: str, *tables: DataFrame) -> list[DataFrame]:
    """Catalogue, cursors, letters and whatever else goes by sink_id, each without one sink."""
    return [t.where(F.col("sink_id") != sink_id) for t in tables]


def reset_sink(sink_id: str, table: DataFrame, state: DataFrame, letters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A sink emptied before it is rebuilt: its table and row state without rows, its letters cleared."""
    return table.limit(0), state.limit(0), letters.where(F.col("sink_id") != sink_id)
