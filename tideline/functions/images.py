"""Row images: ordered arrays of (name, value) text pairs. An absent column differs from one that is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRIES = "array<struct<name:string,value:string>>"


def entry(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))


def image(*entries: Column) -> Column:
    """An image of entries; null entries (absent columns) are left out."""
    return F.filter(F.array(*entries), lambda e: e.isNotNull()).cast(ENTRIES)


def unique_names(img: Column) -> Column:
    return F.size(F.array_distinct(F.transform(img, lambda e: e["name"]))) == F.size(img)


def carries(img: Column, name: Column | str) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.exists(img, lambda e: e["name"] == name)


def value_of(img: Column, name: Column | str) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.get(F.filter(img, lambda e: e["name"] == name), 0)["value"]


def project(img: Column, names: list[str]) -> Column:
    """The named columns in the order of names."""
    return F.flatten(F.array(*[entries_named(img, name) for name in names]))


def entries_named(img: Column, name: str) -> Column:
    return F.filter(img, lambda e: e["name"] == name)


def changed_columns(before: Column, after: Column) -> Column:
    """Names of after that before lacks or holds with another value; null without before."""
    differs = F.filter(after, lambda a: ~F.exists(before, lambda b: (b["name"] == a["name"]) & b["value"].eqNullSafe(a["value"])))
    return F.when(before.isNotNull(), F.transform(differs, lambda e: e["name"]))


def to_image_json(img: Column) -> Column:
    """An object in column order; duplicate names stop the query."""
    return F.to_json(F.map_from_entries(img))


def from_image_json(text: Column) -> Column:
    return F.map_entries(F.from_json(text, "map<string,string>")).cast("array<struct<key:string,value:string>>").cast(ENTRIES)
