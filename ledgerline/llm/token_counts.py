"""Operator 10: exact token counts by rank-synchronous merging.

A text's symbols are merged pair by pair, always the adjacent pair whose joined piece has
the best score and, of equal ones, the leftmost. No piece crosses the start of a run of
word-boundary marks, so the text falls into pre-tokens that are merged independently. New
pre-tokens of a batch are held as one ragged numpy array; each round finds every
sequence's lowest-rank pair with one segmented minimum over (rank, position), merges all
of them at once and drops the sequences that are done. The surviving symbols are counted:
one token each, or one per UTF-8 byte where the symbol is not in the vocabulary.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import id_and_text, small_batches

MARK = "▁"  # stands for a space
NORMAL = 1
NONE = np.int64(1) << 30  # rank of a pair that joins to no piece


class RankMerger:
    """Counts tokens as a sentencepiece BPE model with byte fallback, identity
    normalisation and a leading mark does; raises for other models."""

    loaded: dict[str, RankMerger] = {}

    def __init__(self, path: str, longest: int = 128, most: int = 2_000_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if (
            train.model_type != train.BPE
            or not train.byte_fallback
            or train.treat_whitespace_as_suffix
            or norm.precompiled_charsmap
            or not norm.add_dummy_prefix
            or norm.remove_extra_whitespaces
            or not norm.escape_whitespaces
            or any(p.type in (4, 5) for p in model.pieces)  # user-defined, unused
        ):
            raise ValueError(f"{path}: not a model whose rules this operator follows")
        scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError(f"{path}: a piece has a mark after a letter")
        self.ids = {piece: i for i, piece in enumerate(scores)}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = [
            (self.ids[piece[:i]] * len(scores) + self.ids[piece[i:]], order[score], self.ids[piece])
            for piece, score in scores.items()
            for i in range(1, len(piece))
            if piece[:i] in self.ids and piece[i:] in self.ids
        ]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs] + [np.iinfo(np.int64).max])
        self.ranks = np.array([p[1] for p in pairs] + [NONE], dtype=np.int64)
        self.joined = np.array([p[2] for p in pairs] + [-1], dtype=np.int64)
        self.breaks_lines = not any("\n" in p for p in scores)
        self.longest, self.most = longest, most
        self.counts: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> RankMerger:
        """The one of this Python worker, which serves many tasks."""
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def pretokens(self, text: str) -> list[str]:
        """Runs of marks with the symbols after them; a line feed stands alone where no
        piece holds one."""
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        if "  " in text:
            words = [w.replace(" ", MARK) for w in re.findall(" +[^ ]*", text)]
        else:
            words = [MARK + w for w in text[1:].split(" ")]
        if self.breaks_lines and "\n" in text:
            words = [p for w in words for p in (re.split("(\n)", w) if "\n" in w else (w,)) if p]
        return words

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined piece of adjacent symbols; unknown symbols (-1) join nothing."""
        key = np.where((left < 0) | (right < 0), -1, left * len(self.ids) + right)
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.joined[at], -1)

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each word by rounds over all words at once."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ids = self.ids
        symbols = np.array([ids.get(c, -1) for w in words for c in w], dtype=np.int64)
        widths = np.array([len(c.encode("utf-8", "surrogatepass")) for w in words for c in w])
        cost = np.where(symbols < 0, widths, 1)
        owner = np.repeat(np.arange(len(words)), lengths)
        tokens = np.bincount(owner, cost, len(words)).astype(np.int64)
        # From here on a word's count falls by one with each merge.
        ranks, joined = self.pair(symbols, np.append(symbols[1:], -1))
        while len(owner):
            ends = np.append(owner[1:] != owner[:-1], True)
            ranks[ends] = NONE
            starts = np.append(0, np.flatnonzero(ends)[:-1] + 1)
            best = np.minimum.reduceat((ranks << 32) | np.arange(len(ranks)), starts)
            unfinished = (best >> 32) < NONE
            at = (best & 0xFFFFFFFF)[unfinished]
            tokens[owner[at]] -= 1
            symbols[at] = joined[at]
            keep = np.repeat(unfinished, np.diff(np.append(starts, len(owner))))
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            symbols, owner, ranks, joined = (x[keep] for x in (symbols, owner, ranks, joined))
            follow = np.append(symbols[1:], -1)
            for left in (at[at > 0] - 1, at):  # the pairs on both sides of a merged symbol
                ranks[left], joined[left] = self.pair(symbols[left], follow[left])
        return tokens

    def merge_long(self, word: str) -> int:
        """Tokens of one long pre-token, by a heap of pairs over a linked list."""
        symbols = [self.ids.get(c, -1) for c in word]
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        tokens = sum(
            len(c.encode("utf-8", "surrogatepass")) if s < 0 else 1
            for c, s in zip(word, symbols, strict=True)
        )
        heap = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < size and symbols[left] >= 0 and symbols[right] >= 0:
                key = symbols[left] * len(self.ids) + symbols[right]
                at = int(np.searchsorted(self.keys, key))
                if self.keys[at] == key:
                    state = (symbols[left], symbols[right], int(self.joined[at]))
                    heapq.heappush(heap, (int(self.ranks[at]), left, right, state))

        for left in range(size - 1):
            offer(left, left + 1)
        while heap:
            _, left, right, (first, second, whole) = heapq.heappop(heap)
            if symbols[left] != first or after[left] != right or symbols[right] != second:
                continue
            symbols[left], symbols[right] = whole, None
            after[left] = after[right]
            if after[left] < size:
                before[after[left]] = left
            tokens -= 1
            if before[left] >= 0:
                offer(before[left], left)
            offer(left, after[left])
        return tokens

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pretokens(t) for t in texts]
        if len(self.counts) > self.most:
            self.counts.clear()
        known = self.counts
        unknown = {w for words in split for w in set(words).difference(known)}
        short = [w for w in unknown if len(w) <= self.longest]
        for start in range(0, len(short), 65_536):
            part = short[start : start + 65_536]
            known.update(zip(part, self.merge(part).tolist(), strict=True))
        known.update((w, self.merge_long(w)) for w in unknown if len(w) > self.longest)
        return [sum(map(known.__getitem__, words)) for words in split]


def token_counts(
    docs: DataFrame,
    model: str,
    limit: int = 4096,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """`<id>`, n_bytes, n_tokens, over_limit for every row: the UTF-8 length of the text and
    its number of tokens by the sentencepiece model file, whole, without special tokens.

    A null or empty text has no bytes and no tokens. Repeated rows give repeated rows, a
    row without an id keeps its null, an empty table gives no rows.
    """
    source = id_and_text(docs, id_column, text_column)
    kind = source.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n_bytes", T.LongType(), False),
            T.StructField("n_tokens", T.LongType(), False),
        ]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = RankMerger.load(model)
        for batch in small_batches(batches, 2048):
            counts = merger.count(batch.column(1).to_pylist())
            arrays = [batch.column(0), batch.column(2), pa.array(counts, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    measured = source.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    return measured.mapInArrow(task, schema).select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
