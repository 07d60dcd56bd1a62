"""Packing documents, in order, into sequences of at most `width` tokens.

Documents are range-partitioned by id into parts of about PART_CHARS characters, MAX_PARTS at most (as the ids that a range
partitioning samples at the driver go by the number of parts), so that a part's last, open sequence is a small share. Within a part, runs of RUN_TOKENS are cut by dynamic programming: cut places are ends of documents
and sentences, and inside longer stretches without such an end every SPAN tokens. A window costs its padding plus a
penalty for the kind of cut at its end. With g(i) = cost(i) + position(i),

    cost(j) = penalty(j) + width - position(j) + min g(i) over all i with position(j) - position(i) <= width

and the minimum over the moving range comes from a queue kept in rising order of g, so a run takes linear time.

Defined cases: null and empty texts hold the end id alone; rows with equal ids are packed one after the other; null ids
come first; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.tokens import byte_words, tokenizer

PART_CHARS = 8_000_000
MAX_PARTS = 20_000
RUN_TOKENS = 2_000_000
SPAN = 64
#: Words whose ids a worker keeps, about 150 bytes each.
KEPT_WORDS = 1_200_000
#: Penalties in tokens of padding: at the end of a sentence, and inside one.
SENTENCE, INSIDE = 2, 24
#: Of each byte: whether it is white space, as bytes.split() takes it, and whether it ends a sentence.
SPACE, STOP = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\v\f\r", b".!?"))
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_windows(ends: list[int], penalties: list[int], width: int) -> list[int]:
    """The chosen positions of ends (rising; consecutive ones at most width apart, the first within width of 0), the last included."""
    costs, came = [0] * len(ends), [0] * len(ends)
    queue = deque([(0, 0, -1)])  # g, position, index; g rising from left to right
    for j, (at, penalty) in enumerate(zip(ends, penalties, strict=True)):
        low = at - width
        while queue[0][1] < low:
            queue.popleft()
        g, _, came[j] = queue[0]
        g += penalty + width  # cost(j) + position(j)
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, at, j))
        costs[j] = g - at
    chosen, j = [], len(ends) - 1
    while j >= 0:
        chosen.append(ends[j])
        j = came[j]
    return chosen[::-1]


def cut_places(stops: np.ndarray, doc_ends: np.ndarray, span: int = SPAN) -> tuple[list[int], list[int]]:
    """Positions where a window may end, with penalties."""
    places = np.union1d(stops, doc_ends)
    gaps = np.diff(places, prepend=0)
    wide = np.flatnonzero(gaps > 2 * span)
    if len(wide):
        inside = [np.arange(places[k] - gaps[k] + span, places[k] - span // 2, span) for k in wide]
        places = np.union1d(places, np.concatenate(inside))
    penalties = np.full(len(places), INSIDE)
    penalties[np.isin(places, stops)] = SENTENCE
    penalties[np.isin(places, doc_ends)] = 0
    return places.tolist(), penalties.tolist()


def stop_words(text: bytes) -> np.ndarray:
    """Which words of text.split() end a sentence."""
    raw = np.frombuffer(text, np.uint8)
    space = SPACE[raw]
    ends = np.flatnonzero(np.append(space[1:], True) & ~space)
    return np.flatnonzero(STOP[raw[ends]])


def pack_run(doc_ids: list, ids: list[bytes], stops: list[np.ndarray], width: int, itemsize: int, first_sequence: int) -> tuple[list[list], int]:
    """Columns of the pieces of a run of documents, and how many sequences it fills."""
    lengths = np.array([len(x) // itemsize for x in ids], dtype=np.int64)
    doc_ends = np.cumsum(lengths)
    doc_starts = doc_ends - lengths
    places = cut_places(np.concatenate([s + a for s, a in zip(stops, doc_starts, strict=True)]), doc_ends)
    cuts = np.array(cut_windows(*places, width))
    ends = np.union1d(cuts, doc_ends)
    starts = np.concatenate(([0], ends[:-1]))
    doc = np.searchsorted(doc_ends, starts, side="right")
    window = np.searchsorted(cuts, starts, side="right")
    window_starts = np.concatenate(([0], cuts))[window]
    raw = memoryview(np.frombuffer(b"".join(ids), f"<u{itemsize}").astype("<u4").tobytes())
    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    columns = [[doc_ids[d] for d in doc.tolist()], starts - doc_starts[doc], ends - starts, sums, lengths[doc], first_sequence + window, starts - window_starts]
    return columns, len(cuts)


def pack_documents(docs: DataFrame, tokenizer_path: str, width: int = 2048, end_id: int = 1, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per piece: PIECES."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)).first()[0] or 0
    parts = min(max(1, -(-chars // part_chars)), MAX_PARTS)
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path, KEPT_WORDS)
        size = own.dtype.itemsize
        end = np.array([end_id], own.dtype).tobytes()
        sequence = TaskContext.get().partitionId() << 40
        doc_ids, ids, stops, held = [], [], [], 0

        def packed(first: int) -> tuple[pa.RecordBatch, int]:
            columns, n = pack_run(doc_ids, ids, stops, width, size, first)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")]), n

        for batch in batches:
            texts = batch.column("text")
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), byte_words(texts), own.text_ids(texts), strict=True):
                ended = (stop_words(text or b"") + 1).tolist()
                sentences = [b"".join(found[a:b]) for a, b in zip([0, *ended], ended)]
                doc_ids.append(doc_id)
                ids.append(b"".join([*sentences, *found[ended[-1] if ended else 0 :], end]))
                stops.append(np.cumsum(np.fromiter(map(len, sentences), np.int64, len(sentences))) // size)
                held += len(ids[-1]) // size
                if held >= RUN_TOKENS:
                    out, n = packed(sequence)
                    yield out
                    sequence += n
                    doc_ids, ids, stops, held = [], [], [], 0
        if ids:
            yield packed(sequence)[0]

    return ordered.mapInArrow(run, PIECES)
