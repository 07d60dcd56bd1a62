"""Token ids in files: frequency-ranked ids, byte-aligned variable-length code with separate control bytes.

Every token id gets a rank by its count in the corpus (ties by id; ids that do not occur follow), so frequent ids are
small numbers. A number takes 1 to 4 bytes, least significant first; its length minus 1 goes as two bits into a control
byte shared by four numbers. Control bytes and data bytes lie apart, and a reader decodes a block with two table lookups
and a gather, without a loop over ids.

A store is a folder with `ranks` (rank, token_id) and `blocks`, both Parquet tables so that any file system that Spark
reaches can hold them. A block is a run of documents in ascending order of id:

    magic "TLB1" | documents u32 | ids u64 | doc ids i64 each | null flag u8 each | lengths u32 each | control | data

Documents are range-partitioned by id into shards, blocks are numbered within their shard, and a block keeps how many
ids come before it in the shard. Only the vocabulary's counts and one total per shard come to the driver.

Defined cases: null and empty texts hold the end id alone; null ids come first; documents of equal id are ordered by
length and ids; an empty table gives a store without blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import stage
from tideline.llm.tokens import tokenizer, vocabulary_size

MAGIC = b"TLB1"
END_ID = 1
BLOCK_IDS = 1 << 18
BLOCKS = "shard int, block int, ids_before long, n_docs int, n_ids long, payload binary"

#: Per control byte: the lengths of its four numbers.
LENGTHS = (((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1).astype(np.uint8)


def pack_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, dtype="<u4")
    size = 1 + (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    codes = np.zeros(-len(numbers) % 4 + len(numbers), dtype=np.uint8)
    codes[: len(numbers)] = size - 1
    first, second, third, fourth = codes.reshape(-1, 4).T
    control = first | second << 2 | third << 4 | fourth << 6
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(size.sum(dtype=np.int64), dtype=np.uint8)
    data[at] = numbers.astype(np.uint8)
    for k in range(1, int(size.max(initial=0))):
        longer = np.flatnonzero(size > k)
        data[at[longer] + k] = (numbers[longer] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpack_numbers(control: bytes, data: bytes, count: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    at = np.cumsum(size, dtype=np.int64) - size
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    numbers = padded[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=0))):
        numbers |= (padded[at + k] * (size > k)).astype(np.uint32) << np.uint32(8 * k)
    return numbers


def pack_block(doc_ids: list[int | None], lengths: list[int], numbers: np.ndarray) -> bytes:
    control, data = pack_numbers(numbers)
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    ids = np.array([d or 0 for d in doc_ids], dtype="<i8")
    head = MAGIC + struct.pack("<IQ", len(doc_ids), len(numbers))
    return b"".join((head, ids.tobytes(), nulls.tobytes(), np.array(lengths, "<u4").tobytes(), control, data))


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, numbers)."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    n_docs, n_ids = struct.unpack_from("<IQ", block, 4)
    at = 16
    ids = np.frombuffer(block, "<i8", n_docs, at)
    nulls = np.frombuffer(block, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(block, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    n_control = (n_ids + 3) // 4
    numbers = unpack_numbers(block[at : at + n_control], block[at + n_control :], n_ids)
    return [None if null else int(d) for d, null in zip(ids, nulls, strict=True)], lengths, numbers


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (bytes of the tokenizer's id type) of every whole text, the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        end = np.array([end_id], own.dtype).tobytes()
        for batch in batches:
            ids = [b"".join([*words, end]) for words in own.text_ids(batch.column("text"))]
            sizes = pa.array([len(x) // own.dtype.itemsize for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def joined(values: pa.BinaryArray) -> memoryview:
    """The bytes of all values in a row; none is null."""
    values = values.cast(pa.binary())
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, "<i4", len(values) + 1, 4 * values.offset)
    return memoryview(data or b"")[ends[0] : ends[-1]]


def parted(data: bytes, ends: np.ndarray) -> pa.BinaryArray:
    """Values that end at these bytes of data."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype("<i4")), pa.py_buffer(data)])


def id_counts(tokens: DataFrame, width: int, n_vocab: int) -> DataFrame:
    """token_id, n: each task sums its ids in one array of the vocabulary's size first."""
    dtype = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_vocab, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(joined(batch.column("ids")), dtype)
            for at in range(0, len(ids), BLOCK_IDS):
                total += np.bincount(ids[at : at + BLOCK_IDS], minlength=n_vocab)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token_id", "n"])

    return tokens.select("ids").mapInArrow(run, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def ranked_ids(counts: list[tuple[int, int]], n_vocab: int) -> np.ndarray:
    """Token ids in rank order: by falling count, then by id."""
    n = np.zeros(n_vocab, dtype=np.int64)
    for token_id, count in counts:
        n[token_id] = count
    return np.lexsort((np.arange(n_vocab), -n))


def write_store(docs: DataFrame, path: str, tokenizer_path: str, block_ids: int = BLOCK_IDS, end_id: int = END_ID) -> None:
    spark = docs.sparkSession
    n_vocab = vocabulary_size(tokenizer_path)
    width = tokenizer(tokenizer_path).dtype.itemsize
    tokens = stage(tokenize(docs, tokenizer_path, end_id), "token-ids")
    # one row per id of the vocabulary at most
    by_rank = ranked_ids([(r.token_id, r.n) for r in id_counts(tokens, width, n_vocab).collect()], n_vocab)
    rank_of = np.empty(n_vocab, dtype=np.uint32)
    rank_of[by_rank] = np.arange(n_vocab, dtype=np.uint32)
    spark.createDataFrame([(rank, int(token_id)) for rank, token_id in enumerate(by_rank)], "rank long, token_id long").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = spark.sparkContext.broadcast(rank_of)
    dtype = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        block, before, doc_ids, lengths, parts, held = 0, 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            numbers = ranks.value[np.frombuffer(b"".join(parts), dtype)]
            row = [[shard], [block], [before], [len(doc_ids)], [held], [pack_block(doc_ids, lengths, numbers)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["shard", "block", "ids_before", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                doc_ids.append(doc_id)
                lengths.append(len(ids) // width)
                parts.append(ids)
                held += lengths[-1]
                if held >= block_ids:
                    yield closed()
                    block, before, doc_ids, lengths, parts, held = block + 1, before + held, [], [], [], 0
        if doc_ids:
            yield closed()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids").select("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit little-endian), from the files alone."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # the vocabulary's size, and one row per shard
    by_rank = np.array([r.token_id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], dtype=np.uint32)
    shards = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts = dict(zip([s for s, _ in shards], np.cumsum([0, *[n for _, n in shards]]).tolist(), strict=False))
    table = spark.sparkContext.broadcast((by_rank, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of, base = table.value
        for batch in batches:
            for shard, before, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "ids_before", "payload")), strict=True):
                doc_ids, lengths, numbers = unpack_block(payload)
                ids = id_of[numbers].astype("<u4").tobytes()
                ends = np.cumsum(lengths.astype(np.int64))
                first = ends - lengths
                columns = [pa.array(doc_ids, pa.int64()), pa.array(first + (base[shard] + before)), pa.array(lengths.astype(np.int64)), parted(ids, 4 * ends)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("shard", "ids_before", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
