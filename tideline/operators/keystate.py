"""Row state as maximums over a total order of versions (clock, source, ordinal).

A row's state is its latest delete, its newest live write and, per column, the newest live write that changed it (a
register). A write is live if its version is over every delete's. Each part is a maximum, so states of disjoint batches
merge by taking maximums again, in any order and any number of times; batch and streaming share these functions. Only
aggregates with map-side combination are used, so a hot key costs its group of partial results, not all of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.images import ENTRIES

VERSION = "struct<hlc:bigint,source:string,ordinal:int>"
STATE = ["key", "delete_version", "newest_version", "newest_image", "registers"]


def version() -> Column:
    return F.struct(F.col("hlc").cast("long").alias("hlc"), F.col("source").alias("source"), F.col("ordinal").cast("int").alias("ordinal"))


def registered(names: Column, img: Column) -> Column:
    """Entries of img that count as changed: all of them if names is null."""
    return F.filter(img, lambda e: names.isNull() | F.array_contains(names, e["name"]))


def fold_changes(changes: DataFrame) -> DataFrame:
    """STATE of every key from changes (key, op, hlc, source, ordinal, after, columns). Changes of one version are the same
    change, so repeats have no effect. The log is dealt by key once, to meet its deletes; newest images and registers are
    maximums of the same pass."""
    rows = changes.select("key", "op", version().alias("version"), "after", "columns")
    deletes = rows.groupBy("key").agg(F.max(F.when(F.col("op") == "d", F.col("version"))).alias("delete_version"))
    live = rows.where("op <> 'd'").join(deletes, "key").where(F.col("delete_version").isNull() | (F.col("version") > F.col("delete_version")))
    no_text, no_image = F.lit(None).cast("string"), F.lit(None).cast(ENTRIES)
    part = lambda name, value, img: F.struct(name.alias("column"), value.alias("value"), img.alias("image"))
    entries = F.transform(registered(F.col("columns"), F.col("after")), lambda e: part(e["name"], e["value"], no_image))
    parts = live.select("key", "version", F.explode(F.concat(F.array(part(no_text, no_text, F.col("after"))), entries)).alias("p"))
    best = parts.groupBy("key", "p.column").agg(F.max(F.struct("version", "p.value", "p.image")).alias("r"))
    register = F.when(F.col("column").isNotNull(), F.struct("column", "r.version", "r.value"))
    state = best.groupBy("key").agg(F.max(F.when(F.col("column").isNull(), F.col("r"))).alias("newest"), F.array_sort(F.collect_list(register)).alias("registers"))
    state = deletes.join(state, "key", "left")
    empty = F.array().cast(f"array<struct<column:string,version:{VERSION},value:string>>")
    return state.select("key", "delete_version", F.col("newest.version").alias("newest_version"), F.col("newest.image").alias("newest_image"), F.coalesce("registers", empty).alias("registers"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all changes behind several states (of disjoint or overlapping batches)."""
    every = states[0].select(*STATE)
    for other in states[1:]:
        every = every.unionByName(other.select(*STATE))
    return merge_parts(every)


def merge_parts(every: DataFrame) -> DataFrame:
    """merge_states of a table with a row per key and batch: a key has at most as many rows as there are batches."""
    merged = every.groupBy("key").agg(
        F.max("delete_version").alias("delete_version"),
        F.collect_list(F.struct(F.col("newest_version").alias("version"), F.col("newest_image").alias("image"))).alias("news"),
        F.flatten(F.collect_list("registers")).alias("registers"),
    )
    d = F.col("delete_version")
    live = lambda v: v.isNotNull() & (d.isNull() | (v > d))
    newest = F.array_max(F.filter("news", lambda x: live(x["version"])))
    regs = F.filter("registers", lambda r: live(r["version"]))
    names = F.array_sort(F.array_distinct(F.transform(regs, lambda r: r["column"])))

    def best(name: Column) -> Column:
        own = F.transform(F.filter(regs, lambda r: r["column"] == name), lambda r: F.struct(r["version"].alias("version"), r["value"].alias("value")))
        top = F.array_max(own)
        return F.struct(name.alias("column"), top["version"].alias("version"), top["value"].alias("value"))

    merged = merged.withColumns({"newest": newest, "merged": F.transform(names, best)})
    return merged.select("key", "delete_version", F.col("newest.version").alias("newest_version"), F.col("newest.image").alias("newest_image"), F.col("merged").alias("registers"))


def materialize(state: DataFrame) -> DataFrame:
    """key, row: the newest image overlaid by its registers, then registers of other columns by name; live keys only."""
    regs = F.col("registers")

    def overlaid(e: Column) -> Column:
        own = F.get(F.filter(regs, lambda r: r["column"] == e["name"]), 0)
        return F.struct(e["name"].alias("name"), F.when(own.isNotNull(), own["value"]).otherwise(e["value"]).alias("value"))

    extra = F.filter(regs, lambda r: ~F.exists("newest_image", lambda e: e["name"] == r["column"]))
    row = F.concat(F.transform("newest_image", overlaid), F.transform(extra, lambda r: F.struct(r["column"].alias("name"), r["value"].alias("value"))))
    return state.where("newest_version is not null").select("key", row.alias("row"))


def latest_rows(changes: DataFrame) -> DataFrame:
    """key, row under last writer wins for full images: the image of the newest live write. Equals materialize(fold_changes())
    when every image is whole; with partial images use those."""
    state = changes.groupBy("key").agg(
        F.max(F.when(F.col("op") == "d", version())).alias("d"), F.max(F.when(F.col("op") != "d", F.struct(version().alias("version"), F.col("after").alias("image")))).alias("w")
    )
    return state.where(F.col("w").isNotNull() & (F.col("d").isNull() | (F.col("w.version") > F.col("d")))).select("key", F.col("w.image").alias("row"))


def cells(rows: DataFrame) -> DataFrame:
    """key, column, value: a row per column."""
    return rows.select("key", F.explode("row").alias("e")).select("key", F.col("e.name").alias("column"), F.col("e.value").alias("value"))


def state_json(state: DataFrame) -> DataFrame:
    """key, document: the state as JSON with nulls kept, and read back by state_from_json."""
    return state.select("key", F.to_json(F.struct("delete_version", "newest_version", "newest_image", "registers"), {"ignoreNullFields": "false"}).alias("document"))


def state_from_json(documents: DataFrame) -> DataFrame:
    schema = f"delete_version {VERSION}, newest_version {VERSION}, newest_image array<struct<name:string,value:string>>, registers array<struct<column:string,version:{VERSION},value:string>>"
    return documents.select("key", F.from_json("document", schema).alias("s")).select("key", "s.*")


def outcomes(changes: DataFrame) -> DataFrame:
    """seq, key, op, source, changed, winner_hlc, winner_source, winner_ordinal of every change in delivery order (seq): did it
    move its row's state, and which change is the row's latest after it. Changes without effect win nothing."""
    rows = changes.select("seq", "key", "op", "source", version().alias("version"), "after", "columns")
    before = W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    is_delete = F.col("op") == "d"
    past = lambda cond: F.max(F.when(cond, F.col("version"))).over(before)
    rows = rows.withColumns({"deleted": past(is_delete), "written": past(~is_delete), "winner": F.max("version").over(upto)})
    by_column = W.partitionBy("key", "column").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    touched = rows.where(~is_delete).select("seq", "key", "version", F.explode(registered(F.col("columns"), F.col("after"))).alias("e")).select("seq", "key", "version", F.col("e.name").alias("column"))
    touched = touched.withColumn("earlier", F.max("version").over(by_column))
    moved = touched.groupBy("key", "seq").agg(F.bool_or(F.col("earlier").isNull() | (F.col("version") > F.col("earlier"))).alias("moved"))
    over = lambda other: F.col(other).isNull() | (F.col("version") > F.col(other))
    rows = rows.join(moved, ["key", "seq"], "left")
    changed = over("deleted") & (is_delete | over("written") | F.coalesce("moved", F.lit(False)))
    return rows.select("seq", "key", "op", "source", changed.alias("changed"), F.col("winner.hlc").alias("winner_hlc"), F.col("winner.source").alias("winner_source"), F.col("winner.ordinal").alias("winner_ordinal"))


def conflicts(results: DataFrame) -> DataFrame:
    """Changes that lost to a change of another source."""
    return results.where(~F.col("changed") & (F.col("winner_source") != F.col("source")))
