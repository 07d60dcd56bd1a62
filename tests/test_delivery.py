"""Capture, delivery and sinks on small cases."""

from __future__ import annotations

import glob
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.model import contiguous_mark
from tideline.operators import dispatch, outbox, sinks, stats
from tideline.operators.capture import commit_groups, drop_resent, resent_counts, split_key_changes
from tideline.functions.hlc import stamp_transactions
from tideline.operators.keystate import cells, fold_changes, materialize
from tideline.operators.ranges import values_at, with_places
from tideline.plans import catalog
from tideline.sources.change_log import change_log, decode_messages, message_transactions, read_events, refuse_if_behind, snapshot_scan, table_columns, transactions
from tideline.streaming.apply import CaptureSession, StateTable, apply_stream, capture_stream, files_of


def test_resent_transactions_are_stored_once(spark):
    txns = spark.createDataFrame([("eu", 100 * i, 100 * i + 10) for i in range(1, 11)], "source string, commit_lsn long, end_lsn long")
    stored = spark.createDataFrame([("eu", 410)], "source string, confirmed_lsn long")
    assert drop_resent(txns.union(txns), stored).count() == 6
    assert resent_counts(txns, stored).first().resent == 4
    refuse_if_behind(txns, stored)
    with pytest.raises(ValueError, match="ends before.*eu"):
        refuse_if_behind(txns, spark.createDataFrame([("eu", 5000)], "source string, confirmed_lsn long"))
    with pytest.raises(ValueError, match="ends before"):
        refuse_if_behind(txns.limit(0), stored)


def test_a_key_change_is_a_delete_and_an_insert(spark):
    img = "array<struct<name:string,value:string>>"
    rows = [("eu", 1, 0, "c", "1", None, None, [("a", "1")]), ("eu", 1, 1, "u", "3", "2", [("a", "0")], [("a", "1")]), ("eu", 1, 2, "u", "1", "1", None, [("a", "2")])]
    got = split_key_changes(spark.createDataFrame(rows, f"source string, commit_lsn long, ordinal int, op string, key string, previous_key string, before {img}, after {img}"))
    assert [(r.ordinal, r.op, r.key, r.before is not None, r.after is not None) for r in got.orderBy("ordinal").collect()] == [
        (0, "c", "1", False, True), (1, "d", "2", True, False), (2, "c", "3", False, True), (3, "u", "1", False, True)]


def test_heartbeat_transactions_keep_their_position(spark, sf_dir):
    txns = message_transactions(read_events(spark, sf_dir))
    only = txns.where("txn % 10 = 0").withColumn("messages", F.filter("messages", lambda m: m["table_name"] == "ops.heartbeat"))
    got = decode_messages(only)
    assert got.count() == only.count() and got.where("op is not null").count() == 0
    assert decode_messages(txns).where("op is not null").count() == read_events(spark, sf_dir).count()


def test_batches_do_not_split_transactions(spark):
    rows = spark.createDataFrame([("eu", i, n) for i, n in enumerate([3, 3, 3, 12, 1, 1])], "source string, commit_lsn long, n_changes long")
    assert [r.batch for r in commit_groups(rows, 5).orderBy("commit_lsn").collect()] == [0, 0, 1, 1, 2, 2]


@pytest.mark.parametrize(("most", "width"), [(2000, 3), (7, 10), (1, 4), (50, 1000)])
def test_batches_close_as_one_writer_closes_them(spark, most, width):
    rng = random.Random(most)
    sizes = {"even": [1500] * 6, "odd": [rng.choice([0, 1, 1, 2, 3, 8, 40, 5000]) for _ in range(150)], "one": [3]}
    expected = {}
    for source, own in sizes.items():
        batch = held = 0
        for i, n in enumerate(own):
            expected[source, i] = batch
            held += n
            if held >= most:
                batch, held = batch + 1, 0
    rows = spark.createDataFrame([(s, i, n, "x") for s, own in sizes.items() for i, n in enumerate(own)], "source string, commit_lsn long, n_changes long, other string")
    got = commit_groups(rows, most, width)
    assert got.columns == [*rows.columns, "batch"] and {(r.source, r.commit_lsn): r.batch for r in got.collect()} == expected
    assert commit_groups(rows.limit(0), most, width).count() == 0


def test_the_mark_never_passes_an_unfinished_change(spark):
    rng = random.Random(3)
    cases = {f"s{i}": {s: rng.random() < 0.8 for s in rng.sample(range(1, 100), 12)} for i in range(60)}
    rows = [(name, seq, ok) for name, case in cases.items() for seq, ok in case.items()]
    got = dispatch.marks(spark.createDataFrame(rows, "source string, seq long, finished boolean")).collect()
    assert {r.source: r.mark for r in got} == {name: contiguous_mark(case) for name, case in cases.items()}


def test_a_refused_change_parks_what_follows_it(spark):
    rows = [(1, "1", False), (2, "2", False), (3, "1", True), (4, "3", False), (5, "1", False), (6, "2", False)]
    log = spark.createDataFrame(rows, "seq long, key string, bad boolean").withColumn("source", F.lit("eu"))
    letters = dispatch.dead_letters(log, F.col("bad"))
    assert [(r.seq, r.key, r.error) for r in letters.orderBy("seq").collect()] == [(3, "1", "refused"), (5, "1", "behind a refused change")]
    assert sorted(r.seq for r in dispatch.parked(log, F.lit(False), letters).where("parked").collect()) == [1, 3, 5]
    retried = dispatch.retry_letters(letters, F.lit(False))
    assert (retried.first().letters, retried.first().resolved) == (2, True)
    after = dispatch.after_retry(letters, dispatch.retry_letters(letters, F.col("seq") == 5), 9)
    assert {(r.seq, r.attempts, r.resolved_at) for r in after.collect()} == {(3, 2, None), (5, 2, None)}


def test_start_positions_and_pruning(spark):
    log = spark.createDataFrame([("eu", i, 100 * i, 10 * i) for i in range(1, 6)], "source string, seq long, commit_lsn long, commit_ms long")
    start = {m: dispatch.start_cursors(log, m, 300).first().last_seq for m in ("beginning", "now", "lsn", "snapshot")}
    assert start == {"beginning": 0, "now": 5, "lsn": 2, "snapshot": 2}
    catalog = spark.createDataFrame([("a", "postgres"), ("b", "index")], "sink_id string, kind string")
    cursors = spark.createDataFrame([("a", "eu", 3), ("b", "eu", 0)], "sink_id string, source string, last_seq long")
    kept = lambda c, s, cutoff: sorted(r.seq for r in outbox.retained(log, c, s, cutoff).collect())
    assert kept(cursors, catalog, 100) == [4, 5]
    assert kept(cursors, catalog, 25) == [3, 4, 5]
    assert kept(cursors.where("sink_id = 'b'"), catalog, 45) == [5]


def test_table_sink_keeps_what_an_image_does_not_carry(spark):
    base = spark.createDataFrame([("1", "x", 5), ("2", "y", 6)], "key string, a string, b long")
    rows = spark.createDataFrame([("1", [("a", "new")]), ("3", [("a", None), ("b", "7")])], "key string, row array<struct<name:string,value:string>>")
    touched = spark.createDataFrame([("1",), ("2",), ("3",)], "key string")
    got = sinks.apply_to_table(base, rows, touched, {"a": "string", "b": "bigint"})
    assert {tuple(r) for r in got.collect()} == {("1", "new", 5), ("3", None, 7)}
    with pytest.raises(Exception, match="lacks a column"):
        sinks.apply_to_table(base, rows, touched, {"a": "string"}).collect()


def test_a_whole_row_replaces_what_was_there(spark):
    base = spark.createDataFrame([("1", "x", 5)], "key string, a string, b long")
    rows = spark.createDataFrame([("1", [("a", "new")])], "key string, row array<struct<name:string,value:string>>")
    assert [tuple(r) for r in sinks.apply_to_table(base, rows, rows, {"a": "string", "b": "bigint"}, whole=True).collect()] == [("1", "new", None)]


def test_places_and_values_in_ranges(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([-5, 0, 1, 1, 999, 1000, rng.randint(-3000, 90_000)])) for g, n in (("a", 200), ("b", 1)) for i in rng.sample(range(5000), n)]
    frame = spark.createDataFrame(rows, "g string, i long, v long")
    placed = {(r.g, r.i): r.place for r in with_places(frame, "g", "i", 37).collect()}
    assert placed == {(g, i): 1 + sum(o == g and j < i for o, j, _ in rows) for g, i, _ in rows}
    own = {g: sorted(v for o, _, v in rows if o == g) for g in "ab"}
    got = {r.g: r for r in values_at(frame, "v", ["g"], {"first": F.lit(1), "middle": F.ceil(F.col("n") / 2), "last": F.col("n"), "none": F.col("n") + 1}, 100).collect()}
    assert {g: (r.n, r.first, r.middle, r.last, r.none) for g, r in got.items()} == {g: (len(v), v[0], v[-(-len(v) // 2) - 1], v[-1], None) for g, v in own.items()}


def test_positions_without_fan_out(spark):
    log = spark.createDataFrame([("eu", s, 100 * (s // 3), s) for s in range(1, 30)] + [("us", 7, 50, 7)], "source string, seq long, commit_lsn long, commit_ms long")
    asked = spark.createDataFrame([(s, x) for s in ("eu", "us", "ap") for x in (0, 50, 51, 300, 10**6)], "source string, lsn long")
    got = {(r.source, r.lsn): r.seq for r in outbox.last_seq_before(log, asked).collect()}
    rows = [tuple(r) for r in log.collect()]
    assert got == {(s, x): max((seq for o, seq, lsn, _ in rows if o == s and lsn < x), default=0) for s in ("eu", "us", "ap") for x in (0, 50, 51, 300, 10**6)}
    cursors = spark.createDataFrame([("a", "eu", 0), ("b", "eu", 12), ("c", "eu", 29), ("d", "eu", 12), ("a", "us", 7), ("a", "ap", 3)], "sink_id string, source string, last_seq long")
    found = {(r.sink_id, r.source): (r.head_seq, r.head_lsn, r.pending_lsn, r.pending_ms) for r in outbox.positions(log, cursors).collect()}
    assert found == {("a", "eu"): (29, 900, 0, 1), ("b", "eu"): (29, 900, 400, 13), ("d", "eu"): (29, 900, 400, 13), ("c", "eu"): (29, 900, None, None), ("a", "us"): (7, 50, None, None), ("a", "ap"): (0, None, None, None)}


def test_a_writer_that_was_taken_over_stores_nothing(spark, tmp_path):
    path = str(tmp_path / "outbox")
    rows = spark.createDataFrame([("eu", 1), ("us", 2)], "source string, seq long")
    first = {s: outbox.claim(spark, path, s) for s in ("eu", "us")}
    assert first == {"eu": 1, "us": 1}
    outbox.append_batch(rows, path, 0, first)
    second = first | {"eu": outbox.claim(spark, path, "eu")}
    assert second["eu"] == 2
    with pytest.raises(outbox.StaleEpoch, match="eu"):
        outbox.append_batch(rows, path, 1, first)
    assert outbox.read_outbox(spark, path).count() == 2
    outbox.append_batch(rows, path, 1, second)
    outbox.append_batch(rows.where("source = 'us'"), path, 2, {"us": 1})  # its source is still its own
    assert outbox.read_outbox(spark, path).count() == 5
    with pytest.raises(outbox.StaleEpoch):
        outbox.append_batch(rows, str(tmp_path / "none"), 0, {"eu": 1})


def test_batches_stay_that_were_stored_before_a_take_over(spark):
    claims = spark.createDataFrame([("eu", 1, 0), ("eu", 2, 10)], "source string, epoch long, at long")
    batches = spark.createDataFrame([("eu", 1, 5), ("eu", 1, 15), ("eu", 2, 15), ("eu", 2, 5), ("us", 1, 5)], "source string, epoch long, at long")
    assert {tuple(r) for r in outbox.accepted_batches(batches, claims).collect()} == {("eu", 1, 5), ("eu", 2, 15)}


def test_letters_by_sink_key_and_id(spark):
    rows = [(i, "ab"[i % 2], f"k{i % 3}", 1 if i == 4 else None, 1, "e") for i in range(12)]
    letters = spark.createDataFrame(rows, "id long, sink_id string, key string, resolved_at long, attempts int, error string")
    found = lambda *a, **b: [r.id for r in dispatch.open_letters(letters, *a, **b).collect()]
    assert found("a") == [0, 2, 6, 8, 10] and found("a", "k0") == [0, 6] and found("a", limit=0) == [0] and found("none") == []
    ids = spark.createDataFrame([(2,), (2,), (99,)], "id long")
    assert {r.id: r.resolved_at for r in dispatch.resolve_letters(letters, ids, 7).collect()} == {i: 7 if i == 2 else 1 if i == 4 else None for i in range(12)}
    tried = dispatch.record_attempts(letters, ids, "again")
    assert tried.columns == letters.columns and {(r.id, r.attempts, r.error) for r in tried.collect()} == {(i, 1 + (i == 2), "again" if i == 2 else "e") for i in range(12)}
    assert dispatch.clear_letters(letters, "a").count() == 6


def test_cursors_are_set_and_resumed(spark):
    log = spark.createDataFrame([("eu", i, 100 * i) for i in range(1, 6)], "source string, seq long, commit_lsn long")
    catalog = spark.createDataFrame([("t", "postgres"), ("i", "index")], "sink_id string, kind string")
    cursors = spark.createDataFrame([("t", "eu", 4, 0), ("i", "eu", 4, 300)], "sink_id string, source string, last_seq long, start_lsn long")
    assert {(r.sink_id, r.after_seq) for r in dispatch.resume_positions(log, cursors, catalog).collect()} == {("t", 4), ("i", 2)}
    back = dispatch.set_cursors(cursors, dispatch.replay_cursors(log, "t", 200))
    assert {tuple(r) for r in back.collect()} == {("t", "eu", 1, 200), ("i", "eu", 4, 300)}


def test_a_catalogue_takes_an_id_once(spark):
    have = spark.createDataFrame([("a", "index")], "sink_id string, kind string")
    asked = spark.createDataFrame([("a", "postgres"), ("b", "webhook"), ("b", "index"), ("b", "index")], "sink_id string, kind string")
    assert sorted((r.sink_id, r.kind, r.accepted) for r in sinks.sink_requests(have, asked).collect()) == [("a", "postgres", False), ("b", "index", False), ("b", "index", True), ("b", "webhook", False)]
    assert sorted(tuple(r) for r in sinks.add_sinks(have, asked).collect()) == [("a", "index"), ("b", "index")]


def test_snapshots_of_tables(spark):
    table = spark.createDataFrame([(1, "x", None), (2, "y", 2.5)], "id long, region string, v double")
    assert table_columns(table, ["region", "id"]) == [("id", "bigint", 1, 2), ("region", "string", 2, 1), ("v", "double", 3, None)]
    rows = snapshot_scan(table, "s.t", ["region", "id"]).collect()
    assert [[tuple(e) for e in r.key] for r in rows] == [[("region", "x"), ("id", "1")], [("region", "y"), ("id", "2")]]
    assert [tuple(e) for e in rows[0].after] == [("id", "1"), ("region", "x"), ("v", None)]
    assert snapshot_scan(table.limit(0), "s.t", ["id"]).count() == 0
    with pytest.raises(ValueError, match="no such key"):
        table_columns(table, ["nope"])


def test_versions_and_checkpoints(spark):
    applied = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 2), ("b", 2, 3), ("c", 5, 1), ("c", 6, 1)], "key string, n long, version long")
    assert {(r.key, r.versions, r.breaks) for r in stats.version_breaks(applied).collect()} == {("a", 2, 0), ("b", 2, 1), ("c", 2, 1)}
    stored = spark.createDataFrame([("eu", 10), ("us", 20)], "source string, confirmed_lsn long")
    reached = lambda rows, x: outbox.checkpoint_reached(rows, F.lit(x)).first().reached
    assert reached(stored, 20) and not reached(stored, 21) and not reached(stored.limit(0), 0)


def test_search(spark):
    rows = spark.createDataFrame([("1", "Ada Lovelace"), ("2", "ada"), ("3", "Alan")], "key string, t string")
    index = sinks.postings(rows, F.col("t"))
    tables = sinks.postings(rows.withColumn("table_name", F.when(F.col("key") == "1", "b").otherwise("a")), F.col("t"))
    assert [tuple(r) for r in sinks.search(tables, "ada").collect()] == [("a", "2"), ("b", "1")]
    assert [tuple(r) for r in sinks.search(tables, "ada", table="b").collect()] == [("b", "1")] and sinks.search(tables, "ada", table="c").count() == 0
    found = lambda q: [r.key for r in sinks.search(index, q).collect()]
    assert found("ADA") == ["1", "2"] and found("ada, lovelace") == ["1"] and found("ada turing") == [] and found("...") == []


def test_rates_and_inversions(spark):
    samples = spark.createDataFrame([("a", 0, 1000), ("a", 2000, 7000), ("b", 0, 5000), ("b", 1000, 10)], "name string, at_ms long, total long")
    assert {(r.name, r.at_ms): r.per_second for r in stats.throughput(samples).collect()} == {("a", 0): 0, ("a", 2000): 3000, ("b", 0): 0, ("b", 1000): 0}
    applied = spark.createDataFrame([("k", 1, 1), ("k", 2, 3), ("k", 3, 2)], "key string, n long, seq long")
    assert stats.inversions(applied).first().inversions == 1


def test_streams_repeat_and_resume_without_effect(spark, sf_dir, tmp_path):
    log = change_log(spark, sf_dir)
    expected = {tuple(r) for r in cells(materialize(fold_changes(log))).collect()}
    source = files_of(log, str(tmp_path / "log"), 5)
    schema = spark.read.parquet(source).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    for _ in range(2):
        capture_stream(stream(), str(tmp_path / "outbox"), str(tmp_path / "c1")).awaitTermination()
    stored = outbox.read_outbox(spark, str(tmp_path / "outbox"))
    assert stored.count() == log.count()
    table = StateTable(spark, str(tmp_path / "state"))
    for _ in range(2):
        apply_stream(stream(), table, str(tmp_path / "c2")).awaitTermination()
    current = lambda: {tuple(r) for r in cells(materialize(table.read())).collect()}
    assert current() == expected
    table.fold(log.where("seq % 2 = 0"), 1_000)  # changes that were folded before
    assert current() == expected
    table.compact(1)
    assert current() == expected
    table.fold(log.where("seq % 3 = 0"), 1_001)
    table.compact(1_001)
    assert current() == expected and cells(materialize(StateTable(spark, str(tmp_path / "nothing")).read())).count() == 0


def test_a_capture_batch_that_is_given_again_stores_the_same(spark, sf_dir, tmp_path):
    events = read_events(spark, sf_dir).where("seq < 400")
    txns = message_transactions(events).join(transactions(events).select("source", "txn", "wall_ms", "commit_ms"), ["source", "txn"])
    session = CaptureSession(spark, str(tmp_path / "outbox"))
    shown = lambda: sorted(map(str, outbox.read_outbox(spark, session.outbox).collect()))
    session.store(txns.where("commit_lsn <= 5000"), 0)
    session.store(txns.where("commit_lsn > 4000 and commit_lsn <= 7000"), 1)
    once = shown()
    assert len(once) == 70 * 4
    session.store(txns.where("commit_lsn > 4000 and commit_lsn <= 7000"), 1)
    assert shown() == once
    with pytest.raises(ValueError, match="ends before"):
        session.start(txns, str(tmp_path / "checkpoint"), txns.where("commit_lsn < 1000"))
    session.store(txns.where("commit_lsn < 1000"), 2)  # nothing but resent transactions
    assert shown() == once
    session.store(txns.where("commit_lsn > 6000"), 3)
    expected = {(r.source, r.seq): r.hlc for r in stamp_transactions(transactions(events)).join(events.select("source", "txn", "seq"), ["source", "txn"]).collect()}
    assert sorted(r.hlc for r in outbox.read_outbox(spark, session.outbox).collect()) == sorted(expected.values())


def test_a_log_is_captured_by_more_tasks_than_it_has_sources(spark, sf_dir):
    stored = spark.createDataFrame([("eu", 500, 7), ("us", 900, 9)], "source string, confirmed_lsn long, last_hlc long").groupBy("source").agg(F.max("confirmed_lsn").alias("confirmed_lsn"), F.max("last_hlc").alias("last_hlc"))
    txns = transactions(read_events(spark, sf_dir))
    for rows in (drop_resent(txns, stored), stamp_transactions(txns, stored.drop("confirmed_lsn"))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"BroadcastHashJoin \[source#\d+\]", plan) and not re.search(r"SortMergeJoin(\(skew=\w+\))? \[source#\d+\]", plan)
    found = set(glob.glob(f"{outbox.shared_dir(spark).removeprefix('file:')}/capture-*/log/part-*"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalog.QUERIES["stream_capture"](spark, sf_dir)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    new = set(glob.glob(f"{outbox.shared_dir(spark).removeprefix('file:')}/capture-*/log/part-*")) - found
    assert len(new) > 6  # three deliveries
