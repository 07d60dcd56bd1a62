"""Document fingerprints: bottom-k sketches of the hashes of five-word shingles.

A fingerprint is the K smallest distinct 48-bit shingle hashes of a text, in base64. Two sketches merge into the sketch
of the union by keeping the K smallest of both, so parts can be sketched apart. The share of a union's sketch that
both hold estimates resemblance; the K-th smallest hash estimates the number of distinct shingles; both together give
containment. Below K shingles the sketch is the whole set and every figure is exact.

Words are runs without ASCII white space, A-Z lower-cased; a text with fewer than five words has one shingle, all its
words; a text without words has an empty sketch. Two empty sketches resemble each other by 1, one empty sketch by 0.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import mix64

K = 128
SHINGLE = 5
BYTES = 6
SPACE = 1 << (8 * BYTES)


def word_hashes(data: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, data.lower().split())), "<u8")


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every run of `size` word hashes; of all words if there are fewer."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(words))):
        out = mix64(out + words[k : k + n])
    return out


def sketch(data: bytes, k: int = K, size: int = SHINGLE) -> np.ndarray:
    """The k smallest distinct shingle hashes, rising."""
    hashes = shingle_hashes(word_hashes(data), size) >> np.uint64(64 - 8 * BYTES)
    if len(hashes) > 8 * k:  # the k smallest distinct ones are among these unless many repeat
        few = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def to_text(values: np.ndarray) -> str:
    return base64.b64encode(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BYTES)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 8 - BYTES :] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * SPACE / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, shared / distinct_count(a, k))


def merged_sketches(fingerprints: DataFrame, by: str, column: str = "fingerprint", k: int = K) -> DataFrame:
    """by, fingerprint, n_shingles (estimated) of each group's union. Every task first merges what it has of each group, so
    a group of any size reaches the last step as one sketch per task."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in batches:
            for key, texts in frame.groupby(by, dropna=False)[column]:
                key = None if pd.isna(key) else key
                every = np.unique(np.concatenate([from_text(t) for t in texts]))
                held[key] = merge(held.get(key, every[:0]), every, k)
        yield pd.DataFrame({by: list(held), column: [to_text(v) for v in held.values()]})

    def final(frame: pd.DataFrame) -> pd.DataFrame:
        every = np.unique(np.concatenate([from_text(t) for t in frame[column]]))[:k]
        return pd.DataFrame({by: [frame[by].iloc[0]], column: [to_text(every)], "n_shingles": [distinct_count(every, k)]})

    kind = fingerprints.schema[by].dataType.simpleString()
    rows = fingerprints.select(by, column).mapInPandas(partial, f"{by} {kind}, {column} string")
    return rows.groupBy(by).applyInPandas(final, f"{by} {kind}, {column} string, n_shingles double")


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, fingerprint, n_shingles (estimated) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = [sketch(t.encode(), k) for t in texts]
            columns = [pa.array(map(len, texts), pa.int64()), pa.array(map(to_text, own), pa.string()), pa.array([distinct_count(x, k) for x in own], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_chars", "fingerprint", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string, n_shingles double")


def neighbour_runs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text, tail: documents in falling order of doc_id, range-partitioned, each part followed by the first document
    of the next part that has any (tail = 1; after the last part: the first). Ids that are null come last; equal ids are
    ordered by text. Only one id per part comes to the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = rows.approxQuantile("doc_id", [(i + 1) / parts for i in range(parts - 1)], 0.1 / parts) if parts > 1 else []
    bounds = np.unique(np.array(marks, dtype=np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = len(bounds) - np.searchsorted(bounds, ids.fillna(0).to_numpy().astype(np.int64), side="left")
        return pd.Series(np.where(known, at, len(bounds) + 1).astype(np.int32))

    placed = rows.withColumn("part", part_of("doc_id"))
    firsts = sorted((r.part, r.first) for r in placed.groupBy("part").agg(F.max("doc_id").alias("first")).collect())
    heads = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    found = spark.createDataFrame(heads, "first long, part int")
    tails = rows.join(F.broadcast(found), F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("part", "doc_id").agg(
        F.min(F.struct(F.col("text").isNull().alias("no"), F.col("text").alias("text"))).alias("least")
    )
    every = placed.withColumn("tail", F.lit(0)).unionByName(tails.select("doc_id", F.col("least.text").alias("text"), "part", F.lit(1).alias("tail")))
    dealt = every.repartitionById(len(bounds) + 2, F.col("part"))
    return dealt.sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_last()).select("doc_id", "text", "tail")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last third replaced by the start of the next document), with
    the likeness of the first to the second and to the next document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tail")), strict=True):
                text = text or ""
                own = sketch(text.encode(), k)
                if last is not None:
                    last_id, last_text, last_own, last_tail = last
                    if not last_tail:
                        cut = len(last_text) // 3
                        edited = (last_text[: len(last_text) - cut] + text[:cut]).encode()
                        edited_own = sketch(edited, k)
                        row = (last_id, len(last_text), hashlib.sha256(edited).hexdigest(), to_text(last_own), to_text(edited_own), resemblance(last_own, edited_own, k), resemblance(last_own, own, k))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                last = (doc_id, text, own, tail)
            names = [x.split()[0] for x in EDITED.split(", ")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return neighbour_runs(docs).mapInArrow(run, EDITED)
