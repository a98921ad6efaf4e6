"""Token ids of texts from those of their parts, each different part encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ENTRY_BYTES = 200  # what a remembered part takes beside its text and ids


def text_batches(
    batches: Iterable[pa.RecordBatch], most: int = 4 << 20, column: int = 1
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have `most` bytes in all, or are one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


class PartIds:
    """A memory of the ids of parts of texts.

    `encode` gives the ids (little-endian unsigned 32-bit) of unknown parts. A batch's parts
    are numbered by Arrow, so that only its different ones are looked up. At `memory` bytes the
    memory is set aside and a new one begun, into which parts that come again are taken
    over. Parts longer than `longest` characters are not remembered.
    """

    def __init__(
        self, encode: Callable[[list[str]], list[bytes]], memory: int = 96 << 20, longest: int = 256
    ):
        self.encode, self.memory, self.longest = encode, memory, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def of(self, parts: pa.ListArray) -> list[bytes]:
        """The joined ids of each row's parts."""
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        numbered = pc.dictionary_encode(parts.flatten())
        different = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self._of_different(different)
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
        values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
        lists = pa.LargeListArray.from_arrays(pa.array(ends), values)
        taken = lists.take(numbered.indices)
        bounds = (4 * taken.offsets.to_numpy()[offsets]).tolist()
        data = memoryview(np.ascontiguousarray(taken.values.to_numpy())).cast("B")
        return [bytes(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _of_different(self, parts: list[str]) -> list[bytes]:
        if self.held > self.memory:
            self.older, self.known, self.held = self.known, {}, 0
        ids = list(map(self.known.get, parts))
        missing = [i for i, found in enumerate(ids) if found is None]
        if missing:
            texts = [parts[i] for i in missing]
            found = list(map(self.older.get, texts))
            unknown = [i for i, old in enumerate(found) if old is None]
            for i, new in zip(unknown, self.encode([texts[i] for i in unknown]), strict=True):
                found[i] = new
            for i, new in zip(missing, found, strict=True):
                ids[i] = new
            if max(map(len, texts)) > self.longest:
                kept = [(t, f) for t, f in zip(texts, found, strict=True) if len(t) <= self.longest]
                texts, found = [t for t, _ in kept], [f for _, f in kept]
            self.known.update(zip(texts, found, strict=True))
            self.held += sum(map(len, texts)) + sum(map(len, found)) + ENTRY_BYTES * len(texts)
        return ids
