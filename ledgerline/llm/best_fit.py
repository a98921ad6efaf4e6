"""Operator 11: best-fit packing by exact-complement hashing.

Documents are cut only where they are longer than a sequence. Which lengths share a sequence
is planned on the histogram of piece lengths, which has one line per length whatever the
number of documents: for the longest piece, the lengths left are looked up for one, two or
three that fill its gap exactly, by the sums that singles, pairs and triples of them make;
the combination is used as often as their counts allow. Pieces without an exact complement
come last: the longest takes the longest that fits its gap, again and again, until the rest
of the gap can be filled exactly or nothing fits.

A piece finds its place by its rank among the pieces of its length. Ranks are counted per
task while tokenizing and shifted by the counts of the tasks before, so no length, however
common, is gathered anywhere.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.byte_bpe import ByteIds
from ledgerline.llm.common import id_and_text, releasing
from ledgerline.llm.part_ids import text_batches
from ledgerline.session import materialize

RANK_BITS = 44  # of a piece's number within its length


class Stock:
    """How many pieces of each length are left, and which sums two of the lengths make."""

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self._index()

    def _index(self) -> None:
        size = len(self.left)
        there = int.from_bytes(np.packbits(self.left > 0, bitorder="little").tobytes(), "little")
        sums = 0
        for length in np.flatnonzero(self.left).tolist():
            sums |= there << length
        data = (sums & ((1 << size) - 1)).to_bytes((size + 7) // 8, "little")
        bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
        self.pairs = bits[:size].astype(bool)

    def take(self, pattern: Mapping[int, int]) -> int:
        """How often the pattern can be used up; takes its pieces away."""
        times = min(int(self.left[v]) // k for v, k in pattern.items())
        for length, k in pattern.items():
            self.left[length] -= times * k
        if any(self.left[v] == 0 for v in pattern):
            self._index()
        return times

    def without(self, pattern: Mapping[int, int]) -> np.ndarray:
        left = self.left.copy()
        for length, k in pattern.items():
            left[length] -= k
        return left

    def complement(self, gap: int, pattern: Mapping[int, int]) -> tuple[int, ...] | None:
        """One, two or three lengths that sum to the gap and are there beside the pattern;
        fewest first, then the longest first of them."""
        left = self.without(pattern)
        if left[gap] > 0:
            return (gap,)
        pair = self._pair(gap, left)
        if pair or gap < 3:
            return pair
        firsts = (left[1 : gap - 1] > 0) & self.pairs[gap - 1 : 1 : -1]
        for x in (np.flatnonzero(firsts)[::-1] + 1).tolist():
            left[x] -= 1
            rest = self._pair(gap - x, left)
            left[x] += 1
            if rest:
                return (x, *rest)
        return None

    def _pair(self, gap: int, left: np.ndarray) -> tuple[int, int] | None:
        if not self.pairs[gap]:
            return None
        half = gap // 2
        # From the half upwards, each with its complement.
        both = (left[gap - half : gap] > 0) & (left[half:0:-1] > 0)
        if 2 * half == gap and left[half] == 1:
            both[:1] = False
        found = np.flatnonzero(both)
        if not len(found):
            return None
        x = gap - half + int(found[-1])
        return x, gap - x


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (how often, pieces by length) that use every piece of `counts` (pieces by
    length, 1 to `capacity`) exactly once."""
    stock = Stock({v: n for v, n in counts.items() if n}, capacity)
    patterns: list[tuple[int, dict[int, int]]] = []

    def use(pattern: Counter) -> None:
        patterns.append((stock.take(pattern), dict(pattern)))

    if stock.left[capacity]:
        use(Counter({capacity: 1}))
    for longest in np.flatnonzero(stock.left)[::-1].tolist():
        while stock.left[longest]:
            pattern = Counter({longest: 1})
            fitting = stock.complement(capacity - longest, pattern)
            if fitting is None:
                break
            use(pattern + Counter(fitting))
    while stock.left.any():
        longest = int(np.flatnonzero(stock.left)[-1])
        pattern, gap = Counter({longest: 1}), capacity - longest
        while gap:
            fitting = stock.complement(gap, pattern)
            if fitting is None:
                fits = np.flatnonzero(stock.without(pattern)[: gap + 1] > 0)
                if not len(fits):
                    break
                fitting = (int(fits[-1]),)
            pattern.update(fitting)
            gap -= sum(fitting)
        use(pattern)
    return patterns


@dataclass(frozen=True)
class Places:
    """Where the pieces of a plan stand, by length and rank: five whole numbers per pattern
    and length, at most some thousand patterns whatever the input."""

    first: np.ndarray  # length << RANK_BITS | first rank
    rank: np.ndarray
    each: np.ndarray  # pieces of the length per sequence
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, patterns: list[tuple[int, dict[int, int]]]) -> Places:
        used: Counter = Counter()
        rows, sequence = [], 0
        for times, pattern in patterns:
            offset = 0
            for length in sorted(pattern, reverse=True):
                k = pattern[length]
                rows.append((length << RANK_BITS | used[length], used[length], k, sequence, offset))
                used[length] += times * k
                offset += k * length
            sequence += times
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        return cls(*table.T)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        at = np.searchsorted(self.first, (length << RANK_BITS) + rank, side="right") - 1
        number = rank - self.rank[at]
        return (
            self.sequence[at] + number // self.each[at],
            self.offset[at] + number % self.each[at] * length,
        )


@dataclass(frozen=True)
class Packed:
    """`pieces`: `<id>`, piece, start, length, ids_crc32, doc_tokens, part, rank, sequence_id,
    offset. `tokens`: the stored ids of the pieces by part, length and rank."""

    pieces: DataFrame
    tokens: DataFrame
    sequence_count: int

    def sequences(self) -> DataFrame:
        """`sequence_id`, `ids` (its pieces' ids in order of offset) per sequence."""
        keys = ["part", "length", "rank"]
        ids = self.tokens.select(*keys, "ids")
        placed = self.pieces.select(*keys, "sequence_id", "offset").join(ids, keys)
        parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # capacity at most
        return placed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))


def tokenized(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The pieces of all documents with their ids, and each one's rank among the pieces of its
    length in its task (`part`)."""
    source = id_and_text(docs, id_column, text_column)
    kind = source.schema["id"].dataType
    fields = [
        ("part", T.IntegerType()),
        ("rank", T.LongType()),
        (id_column, kind),
        ("piece", T.IntegerType()),
        ("start", T.LongType()),
        ("length", T.LongType()),
        ("doc_tokens", T.LongType()),
        ("ids_crc32", T.LongType()),
        ("ids", T.ArrayType(T.IntegerType(), False)),
    ]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    end = int(end_id).to_bytes(4, "little")
    width = 4 * capacity

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteIds.load(tokenizer)
        part = TaskContext.get().partitionId()
        ranks = [0] * (capacity + 1)
        for batch in text_batches(batches):
            rows, pieces = [], []
            encoded = encoder.encode(batch.column(1))
            for at, ids in enumerate(encoded):
                ids += end
                cuts = [*range(len(ids) % width or width, len(ids) + 1, width)]
                start = 0
                for piece, cut in enumerate(cuts):
                    held = ids[start:cut]
                    length = len(held) // 4
                    rows.append(
                        (ranks[length], at, piece, start // 4, length, len(ids) // 4, zlib.crc32(held))
                    )
                    ranks[length] += 1
                    pieces.append(held)
                    start = cut
            rank, at, piece, start, length, total, crc = np.array(rows, dtype=np.int64).T
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(pieces), dtype="<i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), part, dtype=np.int32)),
                    pa.array(rank),
                    batch.column(0).take(pa.array(at)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(total),
                    pa.array(crc),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                ],
                names=schema.fieldNames(),
            )

    return source.mapInArrow(releasing(task), schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> Packed:
    """Place all documents in as few sequences of `capacity` tokens as the plan finds.

    A document is its text's ids by a byte-level tokenizer file and the end id; a null or
    empty text is the end id alone. Repeated rows and rows without an id are documents of
    their own; of equally long pieces it is not fixed which shares a sequence with which. Only
    a document longer than a sequence is cut: its first piece is what remains beside whole
    sequences. Sequences are numbered from 0. An empty table gives no pieces. Tokenizes and
    writes the ids to the shared scratch folder when called.
    """
    tokens = materialize(tokenized(docs, tokenizer, end_id, capacity, id_column, text_column))
    counts = tokens.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts)
    histogram = counts.groupBy("length").agg(F.sum("n")).collect()  # one row per length
    patterns = plan(dict(map(tuple, histogram)), capacity)
    places = Places.of(patterns)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    shown = [id_column, "piece", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
    ranked = tokens.select(*shown).join(before, ["part", "length"]).select(*shown, "before")
    schema = T.StructType(
        [*ranked.schema.fields[:-1]]
        + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank, before = (
                batch.column(shown.index("length")).to_numpy(),
                batch.column(shown.index("rank")).to_numpy(),
                batch.column(len(shown)).to_numpy(),
            )
            sequence, offset = places.find(length, rank + before)
            columns = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return Packed(ranked.mapInArrow(task, schema), tokens, sum(n for n, _ in patterns))
