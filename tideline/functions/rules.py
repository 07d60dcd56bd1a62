"""Small rule columns: tokens, outcome classes, validation, settings, limits and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SINK_KINDS = ("postgres", "index", "webhook")
# fixed values: what the surveyed engine accepts as a sink's id and as a table's schema and name
SINK_ID = "^[a-z0-9][a-z0-9-]{0,62}$"
TABLE_NAME = "^[a-z_][a-z0-9_]{0,62}\\.[a-z_][a-z0-9_]{0,62}$"


def search_tokens(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{Nd}]+"), 0))


def http_outcome(status: Column) -> Column:
    return (
        F.when(status.between(200, 299), "ok")
        .when((status == 408) | (status == 429) | (status >= 500), "transient")
        .otherwise("permanent")
    )


def refusal_class(code: Column) -> Column:
    """SQLSTATE classes 22 (data), 23 (constraint) and 42 (access or syntax) will not go away by trying again."""
    return F.when(F.substring(code, 1, 2).isin("22", "23", "42"), "permanent").otherwise("transient")


def sink_problems(sink_id: Column, kind: Column, tables: Column, target: Column) -> Column:
    """What is wrong with a sink's definition, as an array of words."""
    host = F.try_parse_url(target, F.lit("HOST"))
    web = target.rlike("^(?i)https?://") & host.isNotNull()
    checks = [
        (~F.coalesce(sink_id.rlike(SINK_ID), F.lit(False)), "id"),
        (~F.coalesce(kind.isin(*SINK_KINDS), F.lit(False)), "kind"),
        (F.size(tables) == 0, "no tables"),
        (F.exists(tables, lambda t: ~t.rlike(TABLE_NAME)), "table name"),
        (F.size(F.array_distinct(tables)) < F.size(tables), "table twice"),
        ((kind == "webhook") & ~F.coalesce(web, F.lit(False)), "target"),
        ((kind == "postgres") & (F.coalesce(F.trim(target), F.lit("")) == ""), "target"),
        ((kind == "index") & target.isNotNull(), "target"),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(word)) for bad, word in checks]), lambda x: x.isNotNull())


def host_allowed(target: Column, hosts: list[str]) -> Column:
    return F.lower(F.try_parse_url(target, F.lit("HOST"))).isin([h.lower() for h in hosts])


def public_target(target: Column) -> Column:
    """A webhook's target without query and fragment."""
    return F.regexp_replace(target, "[?#].*$", "")


def standby_listed(setting: Column, name: Column) -> Column:
    """Whether a list of synchronous standbys names this one (or all, by *)."""
    names = F.transform(F.split(setting, "[,() ]+"), lambda x: F.lower(F.regexp_replace(x, '^"|"$', "")))
    return F.exists(names, lambda x: (x == "*") | (x == F.lower(name)))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def backoff_ms(attempt: Column, first: int = 100, most: int = 5000) -> Column:
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt), F.lit(float(most))).cast("long")


def sink_state(rebuilding: Column, stopped: Column, retrying: Column) -> Column:
    return F.when(rebuilding, "Rebuilding").when(stopped, "Stopped").when(retrying, "Retrying").otherwise("Running")


def _whole(x: Column) -> Column:
    return F.format_number(F.round(x.cast("double"), 0), 0)


def _one(x: Column) -> Column:
    """At most one decimal, halves away from zero."""
    return F.call_function("format_number", F.round(x.cast("double"), 1), F.lit("#,##0.#"))


def show_count(n: Column) -> Column:
    """A count with separators of thousands."""
    return _whole(n)


def show_rate(per_second: Column) -> Column:
    """A rate, whole from ten a second on."""
    return F.concat(F.when(per_second >= 10, _whole(per_second)).otherwise(_one(per_second)), F.lit("/s"))


def show_duration(ms: Column) -> Column:
    """Milliseconds, from one second on seconds and from one minute on minutes."""
    return (
        F.when(ms < 1000, F.concat(_whole(ms), F.lit(" ms")))
        .when(ms < 60_000, F.concat(_one(ms / 1000), F.lit(" s")))
        .otherwise(F.concat(_one(ms / 60_000), F.lit(" min")))
    )


def show_bytes(n: Column) -> Column:
    """Bytes in the largest binary unit that leaves one or more; "unknown" for null."""
    shown = F.concat(_whole(n), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        shown = F.when(n >= 1024**power, F.concat(_one(n / float(1024**power)), F.lit(f" {unit}"))).otherwise(shown)
    return F.coalesce(shown, F.lit("unknown"))


def show_ago(at_ms: Column, now_ms: Column) -> Column:
    """How long ago, in seconds, minutes or hours; "never" for null."""
    seconds = F.greatest(F.lit(0), F.round((now_ms - at_ms) / 1000, 0).cast("long"))
    in_units = lambda size, unit: F.concat(F.round(seconds / size, 0).cast("long").cast("string"), F.lit(f" {unit} ago"))
    shown = F.when(seconds < 60, in_units(1, "s")).when(seconds < 3600, in_units(60, "min")).otherwise(in_units(3600, "h"))
    return F.when(at_ms.isNull(), "never").otherwise(shown)


def show_key(document: Column) -> Column:
    """A key's JSON object as name=value, name=value; other text as it is."""
    entries = F.map_entries(F.from_json(document, "map<string,string>"))
    shown = F.concat_ws(", ", F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))
    return F.when(F.trim(document).startswith("{") & (F.size(entries) > 0), shown).otherwise(document)


def show_conflict(winner: Column, loser_source: Column, loser_hlc: Column, loser_ordinal: Column) -> Column:
    """A feed's line on a lost change; winner is a version."""
    at = lambda hlc, ordinal: F.concat_ws("/", hlc.cast("string"), ordinal.cast("string"))
    return F.concat(F.lit("kept "), winner["source"], F.lit(" at "), at(winner["hlc"], winner["ordinal"]), F.lit(" over "), loser_source, F.lit(" at "), at(loser_hlc, loser_ordinal))
