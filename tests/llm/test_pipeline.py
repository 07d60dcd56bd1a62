"""The stages of the corpus pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import CLASHING, DOCS, WORD, awkward, components, measures, shingles, water_fill
from tideline.llm import fingerprints, langid, mixing, quality
from tideline.llm.tokens import tokenizer


def copies_around_the_threshold() -> list[tuple]:
    """Texts with a copy each that has a passage of its own at the end, of 10 to 40 % of the text's length."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(40):
        base = [word() for _ in range(rng.randint(60, 150))]
        extra = [word() for _ in range(round(len(base) * (0.10 + 0.30 * k / 40)))]
        rows += [" ".join(base), " ".join(base + extra)]
    rng.shuffle(rows)
    return [(i, t, "en", "s0", len(t)) for i, t in enumerate(rows)] + [(200, "", "en", "s0", 0), (None, None, "en", "s0", 0), (0, rows[0], "en", "s0", 0)]


def kept_by_brute_force(rows: list[tuple]) -> Counter:
    """Of every component the least id once (ids are names of one text here), and all documents without words."""
    found = components([r[:2] for r in rows], size=5, percent=80)
    return Counter([c for c in {c for _, n, c in found if n}] + [d for d, n, _ in found if not n])


def test_near_duplicates_link_from_four_fifths_on(spark):
    rows = copies_around_the_threshold()
    near = [len(a & b) / len(a | b) for a, b in ((shingles(x[1] or "", 5), shingles(y[1] or "", 5)) for k, x in enumerate(rows) for y in rows[:k]) if a & b]
    assert sum(0.8 <= x < 0.85 for x in near) >= 3 and sum(0.75 < x < 0.8 for x in near) >= 3
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()
    assert Counter(r.doc_id for r in got) == kept_by_brute_force(rows)


def test_near_duplicates_are_numbered_once(spark):
    """A shuffle deals the rows by the columns that are read, so two scans of this table number its documents differently."""
    rows = copies_around_the_threshold()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()
    assert Counter(r.doc_id for r in got) == kept_by_brute_force(rows)


# --- every stage against plain Python ----------------------------------------------------------------------------------


def plain_ranks(texts: list[str], most: int) -> dict[int, int]:
    """The most frequent letter n-grams with their ranks; ties by their numbers, which put letters in 10 bits each."""
    counts: Counter = Counter()
    for text in texts:
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split(" ")
        padded = " " + " ".join(w for w in words if w) + " "
        number = [0 if c == " " else ord(c) if ord(c) < 592 else 592 + ord(c) % 431 for c in padded]
        if len(padded) < 3:
            continue
        for i, c in enumerate(number):
            if c:
                counts[c] += 1
            if i:
                counts[(number[i - 1] << 10 | c) | 1 << 30] += 1
            if i > 1 and number[i - 1]:
                counts[(number[i - 2] << 20 | number[i - 1] << 10 | c) & 0xFFFFFFFF | 2 << 30] += 1
    order = sorted(counts, key=lambda g: (-counts[g], g))[:most]
    return {g: k for k, g in enumerate(order)}


def plain_languages(rows: list[tuple]) -> list[tuple[str, float]]:
    """(language, score) of each row."""
    known = defaultdict(list)
    for doc_id, text, lang, *_ in rows:
        if doc_id is not None and text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            known[lang].append(text)
    profiles = {lang: ranks for lang, texts in sorted(known.items()) if (ranks := plain_ranks(texts, 400))}
    found = []
    for _, text, *_ in rows:
        own = plain_ranks([text or ""], 300)
        away = {lang: sum(min(abs(ranks[g] - k), 400) if g in ranks else 400 for g, k in own.items()) / len(own) / 400 for lang, ranks in profiles.items()} if own else {}
        best = min(away, key=away.get, default=None)
        found.append(("und", 0.0) if best is None else (best, 1 - away[best]))
    return found


def plain_fault(line: str) -> str | None:
    words = re.findall(r"\S+", line)
    n = len(words)
    told = {
        "boilerplate": n <= 25 and quality.BOILERPLATE.search(line) is not None,
        "navigation": n >= 4 and 5 * sum(w in "| > » · • / - – —".split() for w in words) >= n,
        "symbols": 10 * sum(bool(set(w) & set("#*$%&|<>")) for w in words) >= 3 * n,
        "shouting": n >= 3 and (2 * sum(w[-2:] == "!!" for w in words) > n or (len(line) >= 20 and line == line.upper() != line.lower())),
        "repetition": n >= 8 and 2 * max(Counter(words).values()) > n,
        "unended": n >= 6 and not any(w.rstrip("\"'”’»)]")[-1:] in set(".!?:;…。！？") for w in words),
    }
    return next((k for k, found in told.items() if n and found), None)


def plain_quality(rows: list[tuple]) -> list[tuple]:
    kept = []
    for doc_id, text, lang, source, _ in rows:
        m = measures(text or "")
        lines = [(x, plain_fault(x), sum(map(len, x.split()))) for x in (text or "").split("\n")]
        good, judged = sum(n for _, f, n in lines if f is None), sum(n for _, f, n in lines if f != "boilerplate")
        if m[0] >= 10 and 100 * m[4] <= 20 * m[0] and good >= 0.5 * max(1, judged):
            clean = "\n".join(x for x, f, _ in lines if f is None)
            kept.append((doc_id, clean, lang, source, len(clean)))
    return kept


def plain_mix(rows: list[tuple], turns: dict[float, int]) -> Counter:
    """Rows by how often they are taken. turns: one of five classes of each key; of each size and class the least key is tried."""
    words = [len(re.findall(WORD, r[1] or "")) for r in rows]
    sizes: dict = defaultdict(int)
    for r, n in zip(rows, words, strict=True):
        sizes[r[3]] += n
    targets, taken = water_fill(dict(sizes)), Counter()
    for source, size in sizes.items():
        epochs = int(targets[source] // size) if size else 0
        rest = max(0, int(targets[source] + 0.5) - epochs * size)
        epochs, rest = (epochs + 1, 0) if size and rest >= size else (epochs, rest)
        own = []
        for r, n in zip(rows, words, strict=True):
            if r[3] == source and n:
                name = str(r[0]) if r[0] is not None else "text:" + hashlib.md5(r[1].encode()).hexdigest()
                u = (int(hashlib.md5(f"17:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                weight = max(0.05, 1 - 4 * len(re.findall("[#*$%&|<>!]", r[1])) / len(r[1]))
                own.append((-math.log(u) / weight, n, r))
        so_far, last = 0, -1.0
        for key in sorted({k for k, _, _ in own}):
            so_far += sum(n for k, n, _ in own if k == key)
            if so_far > rest:
                break
            last, left = key, rest - so_far
        left = rest - sum(n for k, n, _ in own if k <= last)
        least: dict = {}
        for k, n, _ in sorted(own, key=lambda x: x[0]):
            if k > last and n < 2 * left:
                least.setdefault((n, turns[round(k, 9)]), k)
        fits: set = set()
        for _ in range(5 if rest else 0):
            found = min(((abs(n - left), k, n) for (n, _), k in least.items() if n < 2 * left and k not in fits), default=None)
            if found:
                fits.add(found[1])
                left -= found[2]
        for k, _, r in own:
            taken[r] += epochs + int(rest > 0 and (k <= last or k in fits))
    return +taken


@pytest.fixture(scope="module")
def corpus_rows(spark, sf_dir) -> list[tuple]:
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    return rows + [(r[0], r[1], r[2], r[3], r[4]) for r in awkward()] + [(700, "## $$ || " * 50, "en", "s0", 450), (701, rows[5][1] + "\nAll rights reserved.\nhome | news | about | more |", None, None, 9)]


def frame(spark, rows: list[tuple]):
    """With other columns of all the names that operators use inside."""
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in [*CLASHING, "map", "slot", "routes", "hub", "grp", "unit", "mix_key", "clean_text", "lang_pred"]}).repartition(3)


def test_stages_equal_plain_python(spark, corpus_rows, sf_dir):
    rows = corpus_rows
    judged = plain_languages(rows)
    got = langid.predict_languages(frame(spark, rows), langid.learn_profiles(frame(spark, rows)), corpus_pipeline.COLUMNS).collect()
    assert Counter((*tuple(r)[:6], round(r.score, 9)) for r in got) == Counter((*r, lang, round(score, 9)) for r, (lang, score) in zip(rows, judged, strict=True))
    kept = [(r[0], r[1], r[2] or lang, r[3], r[4]) for r, (lang, score) in zip(rows, judged, strict=True) if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    stage = lambda f, rows: Counter(tuple(r) for r in f(spark, frame(spark, rows), sf_dir).collect())
    assert stage(corpus_pipeline.keep_known_languages, rows) == Counter(kept) and len(kept) < len(rows)
    for rows in (corpus_rows, kept):
        clean = plain_quality(rows)
        assert stage(corpus_pipeline.keep_clean_documents, rows) == Counter(clean)
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, frame(spark, clean), sf_dir).collect()
    found = list(zip(clean, components([r[:2] for r in clean], 5, 80), strict=True))
    assert Counter(tuple(r) for r in got) <= Counter(clean)
    by_id = Counter(c for _, (_, n, c) in found if n)  # the least id of a component stands for it, once
    assert sorted((r.doc_id for r in got if r.doc_id is not None)) == sorted(by_id)
    unique = [tuple(r) for r in got]
    for rows in (corpus_rows, unique):
        docs = frame(spark, rows)
        turns = {round(r.mix_key, 9): r.turn for r in mixing.Mix(docs).documents.select("mix_key", F.pmod(F.xxhash64("mix_key"), F.lit(5)).alias("turn")).collect()}
        assert stage(corpus_pipeline.mix_sources, rows) == plain_mix(rows, turns)


def test_packing_stage_holds_every_token_once(spark, corpus_rows, sf_dir):
    own = tokenizer(corpus_pipeline.word_tokenizer())
    rows = corpus_rows[:60] + corpus_rows[-20:]
    lengths = Counter((r[0], len(own.ids(r[1])) + 1) for r in rows)
    pieces = corpus_pipeline.pack_sequences(spark, frame(spark, rows), sf_dir).collect()
    starts: Counter = Counter()
    for p in pieces:
        if p.start == 0:
            starts[p.doc_id, p.doc_tokens] += 1
    assert starts == lengths and sum(p.length for p in pieces) == sum(k[1] * n for k, n in lengths.items())
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for own_ in by_sequence.values():
        at = 0
        for offset, length in sorted(own_):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, sf_dir, name):
    empty = frame(spark, awkward()).limit(0)
    got = dict(corpus_pipeline.STAGES)[name](spark, empty, sf_dir)
    assert got.count() == 0 and (name == "packing" or got.columns == list(corpus_pipeline.COLUMNS))


def test_run_is_its_stages(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, sf_dir).collect(), DOCS)
    own = tokenizer(corpus_pipeline.word_tokenizer())
    assert sum(r.length for r in pieces.collect()) == sum(len(own.ids(r.text)) + 1 for r in docs.collect())


def test_one_very_long_text(spark, sf_dir):
    """400,000 words in lines of many lengths, beside short texts: measured, told apart and sketched as by plain Python."""
    rng = random.Random(6)
    words = [w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").select("text").limit(40).collect() for w in r.text.split()]
    text = "".join(rng.choice(words) + rng.choice([" "] * 12 + ["\n", ".\n"]) for _ in range(400_000))
    rows = [(1, text, "en", "s", 0), (2, "kurz und gut, das ist so.", "de", "s", 0), (3, " ".join(words[:50]), None, "s", 0)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    assert tuple(got[1])[1:6] == measures(text)
    clean = {r[0]: r[1] for r in plain_quality(rows)}
    assert {k: r.clean_text for k, r in got.items() if r.kept} == clean
    predicted = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.predict_languages(docs, langid.learn_profiles(docs)).collect()}
    assert [predicted[r[0]] for r in rows] == [(lang, round(score, 9)) for lang, score in plain_languages(rows)]
    every = fingerprints.shingle_hashes(fingerprints.word_hashes(text.encode())) >> np.uint64(16)
    assert fingerprints.from_text(fingerprints.fingerprint_documents(docs).where("doc_id = 1").first().fingerprint).tolist() == sorted(set(every.tolist()))[: fingerprints.K]


def test_ties_between_languages_go_by_name(spark):
    text = "same words in every language"
    rows = [(i, text, lang, "s", 0) for i, lang in enumerate(["zz", "mm", "aa"] * 20)]
    docs = frame(spark, rows)
    assert {r.lang_pred for r in langid.predict_languages(docs, langid.learn_profiles(docs)).collect()} == {"aa"} == {lang for lang, _ in plain_languages(rows)}
