"""What several of these operators need: reading tables, Arrow batches, tokenizers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.part_ids import ENTRY_BYTES, PartIds

# Word separators of every contract here: space, tab, line feed, vertical tab, form feed,
# carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Two columns, `id` and `text`; a null text is empty. Other columns are not read."""
    return docs.select(
        docs[id_column].alias("id"), F.coalesce(docs[text_column], F.lit("")).alias("text")
    )


def public_tokenizer(name: str) -> str:
    """Path of a tokenizer file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows, so that long texts are unpacked a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def releasing(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task of a mapInArrow, after which what it no longer holds goes back to the system:
    Python workers serve the tasks of later stages too."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


class WordIds:
    """Token ids of whole texts by a tokenizer of the tokenizers library that drops white
    space and folds case (so words do not influence each other).

    The library encodes every different word once, many at a time; a text's ids are those of
    its words in order (see PartIds). A memory of some `most` words of common length is set
    aside when it is full, by its bytes, and a new one begun.
    """

    loaded: dict[str, WordIds] = {}

    def __init__(self, path: str, most: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = PartIds(self._encode_words, most * (ENTRY_BYTES + 40))

    @classmethod
    def load(cls, path: str) -> WordIds:
        """The one of this Python worker, which serves many tasks."""
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without added special tokens."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        # Only ASCII letters are folded here, and not where a special token may be spelt out.
        folded = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        return self.words.of(pc.ascii_split_whitespace(folded))

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words side by side with a space between them, told apart by their places; a word
        that may hold a special token, or a very long one, on its own."""
        apart = [i for i, w in enumerate(words) if "<|" in w or len(w) > 256]
        alone = set(apart)
        joined = [i for i in range(len(words)) if i not in alone]
        found: list[bytes] = [b""] * len(words)
        groups = [joined[at : at + 128] for at in range(0, len(joined), 128)]
        encode = self.tokenizer.encode_batch
        for at in range(0, len(groups), 32):
            some = groups[at : at + 32]
            texts = [" ".join([words[i] for i in group]) for group in some]
            for group, encoding in zip(some, encode(texts, add_special_tokens=False), strict=True):
                ids = np.array(encoding.ids, dtype="<u4")
                places = np.array(encoding.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
                ends = np.cumsum([len(words[i]) + 1 for i in group])
                cuts = (4 * np.searchsorted(places, ends)).tolist()
                data, start = ids.tobytes(), 0
                for i, end in zip(group, cuts, strict=True):
                    found[i] = data[start:end]
                    start = end
        for i in apart:
            ids = self.tokenizer.encode(words[i], add_special_tokens=False).ids
            found[i] = np.array(ids, dtype="<u4").tobytes()
        return found
