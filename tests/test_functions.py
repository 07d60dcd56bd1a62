"""Column functions against plain Python."""

from __future__ import annotations

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions.hlc import hlc_counter, hlc_millis, hlc_pack, stamp_transactions
from tideline.functions.images import ENTRIES, changed_columns, from_image_json, to_image_json, unique_names
from tideline.functions.lsn import lsn_format, lsn_parse, lsn_parse_strict
from tideline.functions.masks import check_key_masks, hmac_sha256, mask_image
from tideline.functions.rules import http_outcome, search_tokens, show_ago, show_bytes, show_count, show_duration, show_key, show_rate, sink_problems
from tests.model import stamps


def test_positions(spark):
    rng = random.Random(8)
    values = [0, 1, 2**32 - 1, 2**32, 2**64 - 1, *(rng.getrandbits(rng.randint(1, 64)) for _ in range(40))]
    good = [f"{v >> 32:X}/{v & 0xFFFFFFFF:x}" for v in values]
    bad = [t for g in good[5:9] for t in (g.replace("/", ""), g + "/0", "-" + g, g + "g", " " + g, "0" * 9 + g)] + ["~", None]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select(lsn_parse(F.col("t")).alias("v")).collect()
    assert [None if r.v is None else int(r.v) for r in rows] == values + [None] * len(bad)
    signed = [v for v in values if v < 2**63]
    back = spark.createDataFrame([(v,) for v in signed], "v long").select(lsn_format(F.col("v"))).collect()
    assert [r[0] for r in back] == [f"{v >> 32:X}/{v & 0xFFFFFFFF:X}" for v in signed]
    strict = lambda t: spark.createDataFrame([(t,)], "t string").select(lsn_parse_strict(F.col("t"))).collect()[0][0]
    assert int(strict(good[6])) == values[6]
    with pytest.raises(Exception, match="not a log position"):
        strict(bad[0])


def test_stamp_parts(spark):
    row = spark.range(1).select(hlc_pack(F.lit(-5), F.lit(3)).alias("a"), hlc_millis(F.lit(7 << 16 | 9)).alias("m"), hlc_counter(F.lit(7 << 16 | 9)).alias("c")).first()
    assert (row.a, row.m, row.c) == (3, 7, 9)


@pytest.mark.parametrize("width", [100, 700, 10**6])
def test_stamps_follow_the_sequential_clock(spark, width):
    rng = random.Random(5)
    rows, expected = [], {}
    for source in ("eu", "us", "ap"):
        clocks = [rng.choice([-3, 0, 10, 10, 11, rng.randint(0, 30)]) for _ in range(60)]
        floor = rng.choice([0, (10 << 16) | 65535])
        rows += [(source, 100 * (i + 1), c, floor) for i, c in enumerate(clocks)]
        expected |= {(source, 100 * (i + 1)): s for i, s in enumerate(stamps(clocks, floor))}
    txns = spark.createDataFrame(rows, "source string, commit_lsn long, wall_ms long, last_hlc long")
    got = stamp_transactions(txns.drop("last_hlc"), txns.select("source", "last_hlc").distinct(), width).collect()
    assert {(r.source, r.commit_lsn): r.hlc for r in got} == expected


def test_full_counter_goes_on_in_the_next_millisecond(spark):
    txns = spark.createDataFrame([("eu", 1, 5)], "source string, commit_lsn long, wall_ms long")
    floors = spark.createDataFrame([("eu", 5 << 16 | 65535)], "source string, last_hlc long")
    assert stamp_transactions(txns, floors).first().hlc == 6 << 16


def test_keyed_hash_is_hmac(spark):
    for key in (b"k" * 32, b"long" * 40):
        values = ["", "a", "é@x.org", None]
        rows = spark.createDataFrame([(v,) for v in values], "v string").select(hmac_sha256(F.col("v"), key)).collect()
        assert [r[0] for r in rows] == [None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in values]


def test_masks_leave_nulls_and_absent_columns(spark):
    rows = spark.createDataFrame([([("email", "a"), ("phone", None)],)], f"img {ENTRIES}")
    got = rows.select(mask_image(F.col("img"), {"email": "hash", "phone": "redact", "city": "redact"}, b"k" * 32).alias("m")).first().m
    assert len(got[0]["value"]) == 64 and got[1]["value"] is None and len(got) == 2
    with pytest.raises(ValueError):
        check_key_masks({"id": "redact"}, ["id"])


def test_images(spark):
    rows = spark.createDataFrame([([("city", "London"), ("plan", "x")], [("city", "Paris"), ("plan", "x"), ("note", None)])], f"b {ENTRIES}, a {ENTRIES}")
    row = rows.select(changed_columns(F.col("b"), F.col("a")).alias("c"), changed_columns(F.lit(None).cast(ENTRIES), F.col("a")).alias("n"), to_image_json(F.col("a")).alias("j")).first()
    assert row.c == ["city", "note"] and row.n is None and row.j == '{"city":"Paris","plan":"x","note":null}'
    back = spark.createDataFrame([(row.j,)], "j string").select(from_image_json(F.col("j")).alias("i")).first().i
    assert [(e["name"], e["value"]) for e in back] == [("city", "Paris"), ("plan", "x"), ("note", None)]
    twice = spark.createDataFrame([([("a", "1"), ("a", "2")],)], f"i {ENTRIES}")
    assert not twice.select(unique_names(F.col("i"))).first()[0]
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        twice.select(to_image_json(F.col("i"))).collect()


def test_rules(spark):
    codes = [200, 299, 301, 400, 408, 429, 500, 503]
    got = spark.createDataFrame([(c,) for c in codes], "c int").select(http_outcome(F.col("c"))).collect()
    assert [r[0] for r in got] == ["ok", "ok", "permanent", "permanent", "transient", "transient", "transient", "transient"]
    assert spark.range(1).select(search_tokens(F.lit("Ada, ada-LOVELACE 42!"))).first()[0] == ["ada", "lovelace", "42"]


def test_numbers_as_shown(spark):
    column = lambda values, show, kind="double": [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(show(F.col("v"))).collect()]
    assert column([5, 999, 1000, 1250, 59_900, 61_000, 7_260_000], show_duration, "long") == ["5 ms", "999 ms", "1 s", "1.3 s", "59.9 s", "1 min", "121 min"]
    assert column([0, 999, 1234567], show_count, "long") == ["0", "999", "1,234,567"]
    assert column([0.0, 0.25, 9.96, 10.0, 1234.5], show_rate) == ["0/s", "0.3/s", "10/s", "10/s", "1,235/s"]
    assert column([None, 0, 1023, 1024, 1536, 1024**2, 5 * 1024**4, 3000 * 1024**4], show_bytes, "long") == ["unknown", "0 B", "1,023 B", "1 KiB", "1.5 KiB", "1 MiB", "5 TiB", "3,000 TiB"]
    assert column([None, 1000, 0, 999_000 - 119_000, 999_000 - 7_300_000, 10**7], lambda at: show_ago(at, F.lit(999_000)), "long") == ["never", "17 min ago", "17 min ago", "2 min ago", "2 h ago", "0 s ago"]
    assert column(['{"id":"7","region":"eu"}', '{"id":null}', "plain", "[1]", "{}"], show_key, "string") == ["id=7, region=eu", "id=null", "plain", "[1]", "{}"]


def test_sink_definitions(spark):
    tables = {"s.t": [], "S.t": ["table name"], "s." + "t" * 63: [], "s." + "t" * 64: ["table name"], "s": ["table name"], "1s.t": ["table name"]}
    cases = [("a", "index", [name], None, found) for name, found in tables.items()]
    cases += [("a", "index", ["s.t"], "x", ["target"]), ("-a", "postgres", ["s.t"], "", ["id", "target"]), ("a" * 63, "webhook", ["s.t"], "HTTP://h/", []), ("a" * 64, "webhook", [], "h", ["id", "no tables", "target"])]
    rows = spark.createDataFrame(cases, "i string, k string, t array<string>, g string, found array<string>")
    got = rows.select(sink_problems(F.col("i"), F.col("k"), F.col("t"), F.col("g")).alias("got"), "found").collect()
    assert [r.got for r in got] == [r.found for r in got]
