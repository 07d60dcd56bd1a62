"""Language identification by rank-order profiles (out-of-place distance).

A profile is the PROFILE most frequent letter n-grams (1 to 3, words padded with a blank) of a language, in order. A
document's own most frequent n-grams are looked up in every profile; each costs the difference of its two ranks, or the
most possible if the profile lacks it. The language with the least sum is predicted, ties by name.

Profiles are learned from labelled documents, about TRAIN_PER_LANG of each language (a hash of the id decides which, so
reruns agree); the bound keeps learning at a fixed cost. Prediction reads whole texts and nothing but the text.

A letter's class is its code point below 592 and one of 431 shared classes above, so that an n-gram fits 32 bits; other
characters are blanks. Defined cases: texts that are null or have no letters are "und" with score 0; so are all if no
label is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import run_starts, slices

PROFILE = 400
DOC_GRAMS = 300
TRAIN_PER_LANG = 3000
UNKNOWN = "und"

_CLASSES: list[np.ndarray] = []


def letter_classes() -> np.ndarray:
    """Per code point: 0 for a blank, else the class of the letter."""
    if not _CLASSES:
        points = np.arange(0x110000)
        classes = np.where(points < 592, points, 592 + points % 431).astype(np.uint32)
        classes[[c for c in range(0x110000) if not chr(c).isalpha()]] = 0
        _CLASSES.append(classes)
    return _CLASSES[0]


def grams(text: str) -> np.ndarray:
    """Sorted n-gram codes of a text: 10 bits a letter, blanks only at a word's edges."""
    letters = letter_classes()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
    if not letters.any():
        return np.zeros(0, dtype=np.uint32)
    letters = np.concatenate(([0], letters, [0])).astype(np.uint32)
    letters = letters[~((letters == 0) & np.concatenate(([False], letters[:-1] == 0)))]  # one blank between words
    two = (letters[:-1] << 10 | letters[1:]) | 1 << 30
    middle = letters[1:-1] != 0
    three = (letters[:-2] << 20 | letters[1:-1] << 10 | letters[2:])[middle] | np.uint32(2 << 30)
    codes = np.concatenate((letters[letters != 0], two, three)).astype(np.uint32)
    codes.sort()
    return codes


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = grams(text)
    starts = run_starts(codes)
    return codes[starts], np.diff(np.append(starts, len(codes)))


def most_frequent(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n codes of the highest counts in falling order, ties by code."""
    order = np.argsort(counts.max(initial=0) - counts, kind="stable")
    return codes[order[:n]]


class Profiles:
    """Per language: its n-grams sorted, with their ranks."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.tables = {}
        for lang in sorted(ranked):
            codes = np.array(ranked[lang], dtype=np.uint32)
            order = np.argsort(codes)
            self.tables[lang] = (codes[order], order)

    def distances(self, text: str) -> dict[str, float]:
        """Mean out-of-place distance to each language as a share of the most possible; empty if there are no letters."""
        codes, counts = gram_counts(text)
        own = most_frequent(codes, counts, DOC_GRAMS)
        if not len(own):
            return {}
        rank = np.arange(len(own))
        found = {}
        for lang, (table, ranks) in self.tables.items():
            at = np.minimum(np.searchsorted(table, own), len(table) - 1)
            away = np.where(table[at] == own, np.minimum(np.abs(ranks[at] - rank), self.size), self.size)
            found[lang] = float(away.mean() / self.size)
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is 1 minus the distance's share of the most possible."""
        found = self.distances(text or "")
        if not found:
            return UNKNOWN, 0.0
        lang = min(found, key=found.get)
        return lang, 1.0 - found[lang]


def held_out(doc_id: Column | None = None) -> Column:
    """The quarter of documents that profiles are never learned from."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_profiles(docs: DataFrame, size: int = PROFILE, per_lang: int = TRAIN_PER_LANG) -> Profiles:
    """From the documents outside the held-out quarter that have an id, a text and a language."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # one row per language
    known = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        return Profiles({})
    share = F.create_map(*[F.lit(x) for lang, n in known.items() for x in (lang, per_lang / n)])[F.col("lang")]
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, dict[int, int]] = {}
        for frame in batches:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                own = sums.setdefault(lang, {})
                codes, counts = gram_counts(text)
                for code, n in zip(codes.tolist(), counts.tolist(), strict=True):
                    own[code] = own.get(code, 0) + n
        for lang, own in sums.items():
            yield pd.DataFrame({"lang": lang, "gram": list(own), "n": list(own.values())})

    counts = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # size rows a language
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in sorted(counts.withColumn("place", place).where(F.col("place") <= size).collect(), key=lambda r: (r.lang, r.place)):
        ranked.setdefault(r.lang, []).append(r.gram)
    return Profiles(ranked, size)


def predict_languages(docs: DataFrame, profiles: Profiles, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of docs, lang_pred, score."""
    at = columns.index("text") if "text" in columns else len(columns)  # a text goes to Python once
    own = docs.select(*columns) if "text" in columns else docs.select(*columns, F.col("text").alias("judged_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [profiles.predict(t) for t in part.column(at).to_pylist()]
                own_ = [part.column(k) for k in range(len(columns))]
                own_ += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(own_, [*columns, "lang_pred", "score"])

    return own.mapInArrow(run, kinds + ", lang_pred string, score double")
