"""Operator 5: packing token sequences by minimum bin slack.

Each task reads its documents once and keeps a pool of pieces no longer than the window,
grouped by length. To fill a window it takes the longest piece and asks a subset-sum
dynamic programme, one bit per reachable total, for the multiset of the other lengths that
comes closest to the capacity; the counts are traced back, and the same multiset is used
as often as the pool allows. Where no multiset fills the window, one more piece is cut to
fit, so that runs of equal lengths (copies) cost no padding either. Each task leaves at
most one window with padding. Nothing is shuffled or gathered, and the pool is bounded by
a number of tokens, so memory does not grow with the input.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import WordIds, id_and_text, releasing
from ledgerline.llm.part_ids import text_batches

PIECES_PER_BATCH = 2048


class Pool:
    """Pieces by length. A piece is (owner, start, ids as bytes of four per id)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_length: dict[int, deque] = {}
        self.lengths: list[int] = []  # those in use, ascending
        self.tokens = 0

    def add(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        if length not in self.by_length:
            self.by_length[length] = deque()
            insort(self.lengths, length)
        self.by_length[length].append(piece)
        self.tokens += length

    def take(self, length: int) -> tuple:
        pieces = self.by_length[length]
        piece = pieces.popleft()
        if not pieces:
            del self.by_length[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.tokens -= length
        return piece

    def fullest(self) -> tuple[dict[int, int], int]:
        """Counts by length of the multiset with the longest piece that fills a window best,
        and its total. Among equal totals longer pieces go first."""
        longest = self.lengths[-1]
        room = self.capacity - longest
        reach, steps = 1, []  # bit t: the other pieces can total t
        full, mask = 1 << room, (1 << (room + 1)) - 1
        for at in range(bisect_left(self.lengths, room + 1) - 1, -1, -1):
            if reach & full:
                break
            length = self.lengths[at]
            left = min(len(self.by_length[length]) - (length == longest), room // length)
            times = 1
            while left > 0 and not reach & full:
                times = min(times, left)
                steps.append((length, times, reach))
                reach |= (reach << (length * times)) & mask
                left -= times
                times *= 2
        total = rest = reach.bit_length() - 1
        counts = {longest: 1}
        for length, times, before in reversed(steps):
            if not before >> rest & 1:
                counts[length] = counts.get(length, 0) + times
                rest -= length * times
        return counts, longest + total

    def windows(self) -> Iterator[list[tuple]]:
        """Fill one window, or several by the same multiset."""
        counts, total = self.fullest()
        slack = self.capacity - total
        times = min(len(self.by_length[v]) // k for v, k in counts.items())
        if slack:
            times = 1
        for _ in range(times):
            window = [self.take(v) for v, k in counts.items() for _ in range(k)]
            if slack and self.lengths:  # every piece left is longer than the slack
                owner, start, ids = self.take(self.lengths[-1])
                window.append((owner, start, ids[: 4 * slack]))
                self.add((owner, start + slack, ids[4 * slack :]))
            yield window


def pack_stream(
    documents: Iterable[tuple], capacity: int, pool_tokens: int
) -> Iterator[list[tuple]]:
    """Windows of pieces (owner, start, ids) from documents (owner, ids)."""
    pool = Pool(capacity)
    width = 4 * capacity
    for owner, ids in documents:
        whole = len(ids) - len(ids) % width
        for at in range(0, whole, width):
            yield [(owner, at // 4, ids[at : at + width])]
        if whole < len(ids):
            pool.add((owner, whole // 4, ids[whole:]))
        if pool.tokens >= pool_tokens:
            while pool.tokens >= pool_tokens // 2:
                yield from pool.windows()
    while pool.lengths:
        yield from pool.windows()


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 2048,
    pool_tokens: int = 1 << 20,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: `<id>`, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.

    A document is its text's ids by the tokenizer file and the end id; a null or empty text
    is the end id alone. Repeated rows and rows without an id are documents of their own.
    A document longer than the window fills whole windows first. Sequence ids are unique,
    not consecutive. An empty table gives no rows.
    """
    source = id_and_text(docs, id_column, text_column)
    kind = source.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField(id_column, kind),
            T.StructField("start", T.LongType(), False),
            T.StructField("length", T.LongType(), False),
            T.StructField("ids", T.BinaryType(), False),
            T.StructField("doc_tokens", T.LongType(), False),
            T.StructField("sequence_id", T.LongType(), False),
            T.StructField("offset", T.LongType(), False),
        ]
    )
    end = int(end_id).to_bytes(4, "little")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.load(tokenizer)
        sequence = TaskContext.get().partitionId() << 33
        owner_type = pa.int64()

        def documents():
            nonlocal owner_type
            for batch in text_batches(batches):
                owner_type = batch.column(0).type
                encoded = words.encode(batch.column(1))
                for owner, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                    ids += end
                    yield (owner, len(ids) // 4), ids

        rows: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            types = [owner_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)],
                names=schema.fieldNames(),
            )

        for window in pack_stream(documents(), capacity, pool_tokens):
            offset = 0
            for (owner, total), start, ids in window:
                length = len(ids) // 4
                rows.append((owner, start, length, ids, total, sequence, offset))
                offset += length
            sequence += 1
            if len(rows) >= PIECES_PER_BATCH:
                yield flushed()
        if rows:
            yield flushed()

    return source.mapInArrow(releasing(task), schema)


def digest(pieces: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        id_column, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )
