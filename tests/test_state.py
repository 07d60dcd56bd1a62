"""Row state against the sequential model, over many random histories in one DataFrame."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.model import KeyModel
from tideline.operators.keystate import conflicts, fold_changes, materialize, merge_states, outcomes, state_from_json, state_json
from tideline.operators.sinks import apply_to_table

SCHEMA = "seq long, key string, op string, hlc long, source string, ordinal int, after array<struct<name:string,value:string>>, columns array<string>"


def histories(n: int, seed: int) -> list[tuple]:
    """n keys with random changes of unique versions, in random order with repeats."""
    rng = random.Random(seed)
    rows, seq = [], 0
    for k in range(n):
        versions = rng.sample([(h, s, o) for h in range(1, 9) for s in ("a", "b", "c") for o in (0, 1)], rng.randint(1, 10))
        own = []
        for h, s, o in versions:
            names = rng.sample("abc", rng.randint(0, 3))
            image = [(c, rng.choice(["x", "y", None])) for c in names]
            columns = rng.choice([None, rng.sample("abc", rng.randint(0, 3))])
            own.append((f"k{k}", "d", h, s, o, None, None) if rng.random() < 0.25 else (f"k{k}", "u", h, s, o, image, columns))
        own += rng.sample(own, min(len(own), rng.randint(0, 3)))
        for row in own:
            rows.append((seq, *row))
            seq += 1
    return rows


def model(rows: list[tuple]) -> dict[str, KeyModel]:
    found: dict[str, KeyModel] = {}
    for _, key, op, h, s, o, image, columns in rows:
        found.setdefault(key, KeyModel()).apply((h, s, o), op, image, columns)
    return found


def shown(df) -> dict[str, list]:
    return {r.key: [(e["name"], e["value"]) for e in r.row] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_merge_and_outcomes_agree_with_the_model(spark, seed):
    rows = histories(300, seed)
    log = spark.createDataFrame(rows, SCHEMA)
    expected = {k: m.row() for k, m in model(rows).items() if m.row() is not None}
    state = fold_changes(log)
    assert shown(materialize(state)) == expected
    parts = [fold_changes(log.where(f"seq % 3 in ({a}, {b})")) for a, b in ((0, 1), (1, 2))]
    assert shown(materialize(merge_states(*parts))) == expected
    assert shown(materialize(state_from_json(state_json(state)))) == expected
    moved, models = {}, {}
    for seq, key, op, h, s, o, image, columns in rows:
        moved[seq] = models.setdefault(key, KeyModel()).apply((h, s, o), op, image, columns)
    got = {r.seq: r.changed for r in outcomes(log).collect()}
    assert got == moved


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10**6), cut=st.integers(0, 60))
def test_any_split_and_order_gives_one_state(spark, seed, cut):
    rows = histories(12, seed)
    mixed = random.Random(seed).sample(rows, len(rows))
    expected = {k: m.row() for k, m in model(rows).items() if m.row() is not None}
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    assert shown(materialize(merge_states(fold_changes(frame(mixed[:cut])), fold_changes(frame(mixed[cut:]))))) == expected


def _full(*values):
    return list(zip(("depth", "gate", "note"), values, strict=True))


#: Histories of one row: (op, hlc, source, ordinal, image, columns), and what is left of it.
CASES = {
    "three sources, a delete between": (
        [("c", 30, "north", 0, _full("1", "open", None), None), ("u", 41, "south", 2, _full("2", "open", "low"), ["depth"]), ("d", 50, "west", 1, None, None), ("u", 50, "west", 2, [("gate", "shut")], None), ("u", 44, "north", 0, _full("9", "9", "9"), None)],
        [("gate", "shut")],
    ),
    "columns of two sources come together": (
        [("u", 72, "south", 0, _full("7", "open", "n0"), ["depth"]), ("c", 12, "north", 1, _full("1", "open", "n0"), None), ("u", 66, "west", 3, _full("1", "shut", "n0"), ["gate"])],
        _full("7", "shut", "n0"),
    ),
    "of equal clocks the greater source wins": ([("u", 80, "west", 0, [("gate", "a")], None), ("u", 80, "north", 5, [("gate", "b")], None)], [("gate", "a")]),
    "of one transaction the later change wins": ([("u", 91, "north", 7, [("depth", "late")], None), ("c", 91, "north", 6, [("depth", "early")], None)], [("depth", "late")]),
    "a delete after everything": ([("d", 99, "south", 0, None, None), ("c", 98, "west", 9, _full("1", "2", "3"), None), ("u", 60, "north", 0, [("note", "x")], ["note"])], None),
    "a column that later images lack": ([("c", 21, "west", 0, _full("5", "open", "kept"), None), ("u", 22, "west", 0, [("depth", "6"), ("gate", "open")], None)], _full("6", "open", "kept")),
}


@pytest.mark.parametrize("name", CASES)
def test_golden_cases(spark, name):
    changes, expected = CASES[name]
    rows = [(i, "k", op, h, s, o, image, columns) for i, (op, h, s, o, image, columns) in enumerate(changes)]
    assert shown(materialize(fold_changes(spark.createDataFrame(rows, SCHEMA)))) == ({} if expected is None else {"k": expected})


def test_a_lost_write_of_another_source_is_a_conflict(spark):
    rows = [(1, "k", "u", 20, "us", 0, [("a", "1")], None), (2, "k", "u", 10, "eu", 0, [("a", "2")], None)]
    lost = conflicts(outcomes(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r.seq, r.winner_source) for r in lost] == [(2, "us")]


COLUMNS = {"a": "string", "b": "string", "c": "string"}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10**6), cuts=st.lists(st.integers(0, 60), min_size=1, max_size=2))
def test_any_split_into_batches_gives_one_table(spark, seed, cuts):
    rows = histories(12, seed)
    mixed = random.Random(seed).sample(rows, len(rows))
    table = spark.createDataFrame([], "key string, a string, b string, c string")
    state = fold_changes(spark.createDataFrame([], SCHEMA))
    ends = [0, *sorted(cuts), len(mixed)]
    for low, high in zip(ends, ends[1:], strict=False):
        batch = spark.createDataFrame(mixed[low:high], SCHEMA)
        state = spark.createDataFrame(merge_states(state, fold_changes(batch)).collect(), state.schema)
        table = spark.createDataFrame(apply_to_table(table, materialize(state), batch.select("key"), COLUMNS, whole=True).collect(), table.schema)
    expected = {k: dict(m.row()) for k, m in model(rows).items() if m.row() is not None}
    assert {r.key: (r.a, r.b, r.c) for r in table.collect()} == {k: tuple(v.get(c) for c in COLUMNS) for k, v in expected.items()}


def test_no_changes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert materialize(fold_changes(empty)).count() == 0 and outcomes(empty).count() == 0
