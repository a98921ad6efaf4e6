"""Operator 6: token ids in Simple-8b words.

A 64-bit word has a selector in its upper four bits that says how many ids of how many
bits the other sixty hold. Ids too wide for any selector go to a list of exceptions, and an
escape word holds the place in it. Ids are coded in blocks, each with its offset in the word
stream, so blocks are coded side by side and decoded in one vectorised pass.

A file is made of segments of whole documents in ascending order of id. Spark writes and
commits the segments (as rows of Parquet: the ids, the counts and the coded bytes), so a
lost executor leaves no half-written file behind, and any reader of the store gets them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import WordIds, id_and_text, releasing, small_batches
from ledgerline.llm.part_ids import text_batches
from ledgerline.session import scratch_dir

# Ids per word and bits per id, by selector. Selector 0 is the escape.
COUNTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
LEAST = np.uint64(1) << BITS[1:].astype(np.uint64)  # the first id too wide for a selector
MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIQQQ")  # magic, ids per block, ids, words, exceptions
SEGMENT_IDS = 1 << 20


def encode(ids: np.ndarray, block: int = 4096) -> bytes:
    """The ids (non-negative 64-bit integers) as one coded segment."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    starts = np.arange(0, n, block)
    # The narrowest selector that holds an id, 16 for none; 0 after the end, where all fits.
    need = np.zeros((len(starts), block), dtype=np.uint8)
    need.ravel()[:n] = np.searchsorted(LEAST, ids, side="right") + 1
    selector = np.zeros(need.shape, dtype=np.uint8)
    for s in range(int(need.ravel()[:n].min(initial=16)), 16):
        # Whether the ids from here on, as many as a word holds or the block has left, fit.
        fits, seen = need <= s, 1
        while seen < min(COUNTS[s], block):
            step = int(min(seen, COUNTS[s] - seen, block - 1))
            fits[:, :-step] &= fits[:, step:].copy()
            seen += step
        np.copyto(selector, s, where=fits & (selector == 0))
        if selector.all():
            break
    selector = selector.ravel()[:n]
    taken = COUNTS[selector]
    heads = []
    ends = np.minimum(n, starts + block)
    active = starts
    while len(active):
        heads.append(active)
        active = active + taken[active]
        ends_here = active < ends
        active, ends = active[ends_here], ends[ends_here]
    head = np.sort(np.concatenate(heads)) if heads else np.zeros(0, dtype=np.int64)
    chosen = selector[head]
    words = np.zeros(len(head), dtype=np.uint64)
    escaped = chosen == 0
    exceptions = ids[head[escaped]]
    words[escaped] = np.arange(len(exceptions), dtype=np.uint64)
    for s in np.unique(chosen[~escaped]):
        rows = np.flatnonzero(chosen == s)
        until = np.minimum(n, (head[rows] // block + 1) * block)
        for j in range(COUNTS[s] if BITS[s] else 0):
            held = rows[head[rows] + j < until]
            words[held] |= ids[head[held] + j] << np.uint64(j * BITS[s])
    words |= chosen.astype(np.uint64) << np.uint64(60)
    offsets = np.searchsorted(head, starts).astype("<u8")
    return b"".join(
        (
            HEADER.pack(MAGIC, block, n, len(words), len(exceptions)),
            offsets.tobytes(),
            words.astype("<u8").tobytes(),
            exceptions.astype("<u8").tobytes(),
        )
    )


def decode(data: bytes) -> np.ndarray:
    """The ids of a coded segment, as unsigned 64-bit integers."""
    magic, block, n, n_words, n_exceptions = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    blocks = -(-n // block)
    parts = np.frombuffer(data, dtype="<u8", offset=HEADER.size)
    if len(parts) != blocks + n_words + n_exceptions:
        raise ValueError("a Simple-8b segment is cut short")
    offsets = parts[:blocks].astype(np.int64)
    words = parts[blocks : blocks + n_words]
    exceptions = parts[blocks + n_words :]
    chosen = (words >> np.uint64(60)).astype(np.int64)
    # A word's first id: the ids of the words before it in its block, after the block's start.
    before = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    of_block = np.repeat(np.arange(blocks), np.diff(np.append(offsets, n_words)))
    first = before - before[offsets][of_block] + of_block * block
    end = np.minimum((of_block + 1) * block, n)
    ids = np.zeros(n, dtype=np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            ids[first[rows]] = exceptions[payload[rows].astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(COUNTS[s] if BITS[s] else 0):
            held = rows[first[rows] + j < end[rows]]
            ids[first[held] + j] = (payload[held] >> np.uint64(j * BITS[s])) & mask
    return ids


def write_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write every text's ids and the end id, documents in ascending order of id.

    Nulls come first; equal ids are ordered by a hash of the text, repeated rows stay
    repeated. A null or empty text has the end id alone. An empty table leaves no segments.
    Columns of a segment: part (ascending with the ids), first (ids of the part before
    it), doc_ids, counts (ids per document), data.
    """
    source = id_and_text(docs, id_column, text_column)
    kind = source.schema["id"].dataType
    # The row number keeps many copies of one row from meeting in one task.
    order = ["id", F.xxhash64("text"), "row"]
    ordered = (
        source.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("id", "text")
    )
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("data", T.BinaryType()),
        ]
    )
    end = int(end_id).to_bytes(4, "little")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.load(tokenizer)
        part, first, id_type = TaskContext.get().partitionId(), 0, pa.int64()
        owners, coded, held = [], [], 0

        def segment() -> pa.RecordBatch:
            nonlocal first, held
            ids = np.frombuffer(b"".join(coded), dtype="<u4")
            columns = [
                pa.array([part], pa.int32()),
                pa.array([first], pa.int64()),
                pa.array([owners], pa.list_(id_type)),
                pa.array([[len(c) // 4 for c in coded]], pa.list_(pa.int64())),
                pa.array([encode(ids)], pa.binary()),
            ]
            first += len(ids)
            held = 0
            owners.clear()
            coded.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        for batch in text_batches(batches):
            id_type = batch.column(0).type
            found = words.encode(batch.column(1))
            for owner, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                owners.append(owner)
                coded.append(ids + end)
                held += len(coded[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield segment()
        if owners:
            yield segment()

    ordered.mapInArrow(releasing(task), schema).write.parquet(path)


def _decoded(segments: DataFrame, schema: T.StructType, digests: bool) -> DataFrame:
    """Each document of the segments: its id, the segment's part, the ids before it, and its ids
    or their number and checksum. The segments' other columns come first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            place, first, _, counts, data = (c[0].as_py() for c in batch.columns)
            ids = decode(data).astype("<u4")
            ends = np.cumsum(counts)
            starts = ends - counts
            held = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            columns = [
                batch.column(2).flatten(),
                pa.array([place] * len(counts), pa.int64()),
                pa.array(first + starts, pa.int64()),
            ]
            if digests:
                columns += [pa.array(counts, pa.int64()), pa.array(map(zlib.crc32, held), pa.int64())]
            else:
                columns.append(pa.array(held, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return segments.mapInArrow(releasing(task), schema)


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, T.DataType]:
    """The segments; for each part, of which there are as many as tasks wrote, the ids of all
    parts before it; and the type of the documents' ids."""
    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("n")
    )
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return segments, totals, segments.schema["doc_ids"].dataType.elementType


def _layout(kind: T.DataType, *more: tuple[str, T.DataType]) -> T.StructType:
    fields = [("id", kind), ("place", T.LongType()), ("within", T.LongType()), *more]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def read_files(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """`<id>`, start (ids of all documents before it), ids (binary, little-endian unsigned
    32-bit) per document, from the files alone. Coded segments may be shuffled to their
    part's total, decoded ids are not."""
    segments, totals, kind = _read(spark, path)
    placed = segments.join(totals, "part").select("before", "first", "doc_ids", "counts", "data")
    documents = _decoded(placed, _layout(kind, ("ids", T.BinaryType())), False)
    return documents.select(
        F.col("id").alias(id_column), (F.col("place") + F.col("within")).alias("start"), "ids"
    )


def read_digests(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """`<id>`, start, n_tokens, ids_crc32 per document, from the files alone. The task that
    decodes a segment checks its ids; none of them leaves it."""
    segments, totals, kind = _read(spark, path)
    columns = segments.select(F.col("part").cast("bigint"), "first", "doc_ids", "counts", "data")
    more = (("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))
    documents = _decoded(columns, _layout(kind, *more), True)
    return documents.join(totals, F.col("place") == F.col("part")).select(
        F.col("id").alias(id_column), (F.col("before") + F.col("within")).alias("start"),
        "n_tokens", "ids_crc32",
    )


def round_trip(
    docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id"
) -> DataFrame:
    """Write the files to the shared scratch folder and describe each document as read back:
    `<id>`, start, n_tokens, ids_crc32. Writes when called."""
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/simple8b-{uuid.uuid4().hex}"
    write_files(docs, path, tokenizer, end_id, id_column)
    return read_digests(spark, path, id_column)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
