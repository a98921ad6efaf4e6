"""Operator 9: scoring texts by a recurrent language model.

Words are counted over all training documents: tasks count their own, the counts meet per
word. From them come the base score and the model's outputs: the commonest words
(MODEL_WORDS), the end, and a few kinds of rarer word, told apart by form. A rarer word's
probability is that of its kind, given the state, times its smoothed share of the kind's
count, so every text has a proper probability whatever words it holds.

The recurrent model (gru.py) is trained where the documents are: all training documents, a
part of them in each of ROUNDS rounds, are dealt to trainers of a bounded number of tokens,
each makes a pass of truncated backpropagation from the same start, and the parameters are
averaged in groups until one model is left. So what training gathers grows with the input,
and no task or driver holds more than a few models.

Scoring reads every document once. The commonest words (KNOWN_WORDS, a bounded table) are
looked up in the task; what is left of a document, its rarer words, meets their counts in a
join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import id_and_text, small_batches
from ledgerline.llm.gru import Gru
from ledgerline.session import materialize

MODEL_WORDS = 4_096
KNOWN_WORDS = 100_000
CLASSES = 64
KINDS = 16
ROUNDS = 2  # a hash deals the training documents to them, each to one
TRAINER_TOKENS = 1_600_000  # lanes as long as long texts, lest few lanes run on alone
GROUP = 16  # models averaged in one task
BUFFER_TOKENS = 5_000_000  # for the same reason
END = b""
NO_KIND = -1


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts as bytes, only A-Z folded, and each word's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owners = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    words = lists.flatten()
    empty = pc.equal(pc.binary_length(words), 0)  # beside white space at an end of a text
    if pc.any(empty).as_py():
        full = pc.invert(empty)
        words, owners = words.filter(full), owners[full.to_numpy(zero_copy_only=False)]
    return words.cast(pa.binary()), owners


def kind_of(word: bytes) -> int:
    """One of 16 forms: length, a mark at the end, letters beyond ASCII."""
    length = (len(word) > 5) + (len(word) > 9) + (len(word) > 14)
    return length * 4 + (word[-1:] in b".,;:!?|") * 2 + (not word.isascii())


MARK = np.isin(np.arange(256), list(b".,;:!?|"))


def kinds_of(words: pa.Array) -> np.ndarray:
    """kind_of for many words, none of them empty."""
    if not len(words):
        return np.zeros(0, dtype=np.int32)
    lengths = pc.binary_length(words).to_numpy()
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32, count=words.offset + len(words) + 1)[words.offset + 1 :]
    marked = MARK[np.frombuffer(data, dtype=np.uint8)[ends - 1]]
    plain = pc.string_is_ascii(words.view(pa.string())).to_numpy(zero_copy_only=False)
    level = (lengths > 5).astype(np.int32) + (lengths > 9) + (lengths > 14)
    return (level * 4 + marked * 2 + ~plain).astype(np.int32)


def trains(id_column: Column) -> Column:
    """Rows to learn from: the checksum of the id's digits leaves another rest than 1 by 5."""
    other = F.crc32(id_column.cast("string").cast("binary")) % 5 != 1
    return F.coalesce(other, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """`word` (binary, empty for the end), `kind`, `n` over the texts of the column `text`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [], 0  # tables of words and counts, not yet added up; texts

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])

        def flushed() -> Iterator[pa.RecordBatch]:
            words = added().combine_chunks() if held else None
            held.clear()
            for batch in words.to_batches(max_chunksize=65_536) if words else []:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("word"),
                        pa.array(kinds_of(batch.column("word"))),
                        batch.column("n_sum"),
                    ],
                    names=["word", "kind", "n"],
                )

        for batch in small_batches(batches):
            ends += batch.num_rows
            found = words_of(batch.column(0))[0].value_counts()
            held.append(pa.Table.from_arrays(found.flatten(), names=["word", "n"]))
            if sum(t.num_rows for t in held) > 1_000_000:
                total = added().rename_columns(["word", "n"])
                held[:] = [total]
                if total.num_rows > 500_000:
                    yield from flushed()
        yield from flushed()
        if ends:
            yield pa.RecordBatch.from_arrays(
                [pa.array([END]), pa.array([NO_KIND], pa.int32()), pa.array([ends])],
                names=["word", "kind", "n"],
            )

    counted = docs.select("text").mapInArrow(task, "word binary, kind int, n bigint")
    return counted.groupBy("word", "kind").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The commonest words in order, and what the rest amounts to."""

    words: list[bytes]  # by falling count
    counts: np.ndarray
    total: int
    distinct: int
    end_count: int
    kind_counts: np.ndarray  # over words that are no outputs of their own
    kind_words: np.ndarray
    model_words: int

    @classmethod
    def of(cls, counts: DataFrame, known: int, model_words: int) -> Vocabulary:
        """Collects at most `known` words, those above a count that few words reach."""
        eighths = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
        plain = counts.filter(F.col("kind") != NO_KIND)
        by_kind = counts.groupBy("kind", eighths.alias("level")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")
        ).collect()  # some 500 levels of 17 kinds
        levels: Counter = Counter()
        for row in by_kind:
            if row["kind"] != NO_KIND:
                levels[row["level"]] += row["words"]
        least, held = None, 0
        for level in sorted(levels, reverse=True):
            held += levels[level]
            if held > known:
                break
            least = level
        chosen = [] if least is None else plain.filter(eighths >= least).collect()
        chosen.sort(key=lambda r: (-r["n"], bytes(r["word"])))
        kind_counts, kind_words = np.zeros(KINDS), np.zeros(KINDS)
        total = distinct = end = 0
        for row in by_kind:
            total += row["n"]
            distinct += row["words"]
            if row["kind"] == NO_KIND:
                end = row["n"]
            else:
                kind_counts[row["kind"]] += row["n"]
                kind_words[row["kind"]] += row["words"]
        words = [bytes(r["word"]) for r in chosen]
        numbers = np.array([r["n"] for r in chosen], dtype=np.float64)
        model_words = min(model_words, len(words))
        for word, n in zip(words[:model_words], numbers, strict=False):
            kind_counts[kind_of(word)] -= n
            kind_words[kind_of(word)] -= 1
        return cls(words, numbers, total, distinct, end, kind_counts, kind_words, model_words)

    @property
    def end(self) -> int:
        return self.model_words

    @cached_property
    def reader(self) -> Reader:
        """Made once in each worker that is sent the vocabulary."""
        return Reader(self)

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """First outputs of the classes (and the end), and the outputs' weights."""
        weights = np.concatenate(
            [self.counts[: self.model_words], [self.end_count], self.kind_counts]
        ) + 0.5
        own = weights[: self.model_words]
        shares = (np.cumsum(own) - own / 2) / max(own.sum(), 1)
        level = np.minimum((shares * CLASSES).astype(int), CLASSES - 1)
        starts = np.flatnonzero(np.append(True, np.diff(level) > 0)) if len(own) else []
        single = np.arange(self.model_words, len(weights) + 1)
        return np.concatenate([starts, single]).astype(np.int64), weights


def sums(owners: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of each of `n` owners' values, also where there are none at all."""
    return np.bincount(owners, values, n).astype(np.float64)


class Reader:
    """Turns texts into outputs and the parts of scores that need no state."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.words = pa.array(v.words, pa.binary())
        first_kind = v.end + 1
        kinds = kinds_of(self.words)
        places = np.arange(len(v.words))
        self.output = np.where(places < v.model_words, places, first_kind + kinds).astype(np.int32)
        self.log_count = np.log10(v.counts + 0.5)
        self.first_kind = first_kind
        self.base_of = np.log10(v.total + 0.5 * (v.distinct + 1))
        self.kind_of = np.log10(v.kind_counts + 0.5 * (v.kind_words + 1))
        self.end_log = np.log10(v.end_count + 0.5)

    def _looked_up(self, texts: pa.Array) -> tuple:
        """Words, their texts, their places among the known words (or -1), and their outputs."""
        words, owners = words_of(texts)
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        if not len(self.words):
            return words, owners, at, self.first_kind + kinds_of(words)
        wanted = self.output[at]
        far = np.flatnonzero(at < 0)
        wanted[far] = self.first_kind + kinds_of(words.take(pa.array(far)))
        return words, owners, at, wanted

    def _by_text(self, wanted: np.ndarray, owners: np.ndarray, texts: int) -> list[np.ndarray]:
        """Each text's outputs, the end behind them."""
        flat = np.full(len(wanted) + texts, self.vocabulary.end, dtype=np.int32)
        flat[np.arange(len(wanted)) + owners] = wanted
        ends = (np.cumsum(np.bincount(owners, minlength=texts) + 1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def outputs(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's outputs."""
        _, owners, _, wanted = self._looked_up(texts)
        return self._by_text(wanted, owners, len(texts))

    def read(self, texts: pa.Array | str) -> tuple:
        """Of each text: outputs; known words; base and model score without the state's part
        and without the logarithms of the far words' counts; the far words, and how often each
        occurs. One text given as such: its own, the far words counted."""
        if isinstance(texts, str):
            outputs, known, base, inside, far = self.read(pa.array([texts]))
            far = Counter({f["word"]: f["times"] for f in far[0].as_py()})
            return outputs[0], int(known[0]), float(base[0]), float(inside[0]), far
        v, n = self.vocabulary, len(texts)
        words, owners, at, wanted = self._looked_up(texts)
        outputs = self._by_text(wanted, owners, n)
        near = at >= 0
        held, held_by = at[near], owners[near]
        tokens = np.bincount(owners, minlength=n) + 1
        logs = self.log_count[held]
        base = sums(held_by, logs, n) + self.end_log - tokens * self.base_of
        own = held >= v.model_words
        rare = wanted >= self.first_kind
        inside = sums(held_by[own], logs[own], n)
        inside -= sums(owners[rare], self.kind_of[wanted[rare] - self.first_kind], n)
        known = np.bincount(held_by, minlength=n) + (v.end_count > 0)
        far_at = np.flatnonzero(~near)
        coded = words.take(pa.array(far_at)).dictionary_encode()
        different = max(1, len(coded.dictionary))
        pairs, times = np.unique(
            owners[far_at] * different + coded.indices.to_numpy(), return_counts=True
        )
        starts = np.searchsorted(pairs, np.arange(n + 1) * different).astype(np.int32)
        far = pa.StructArray.from_arrays(
            [coded.dictionary.take(pa.array(pairs % different)), pa.array(times, pa.int64())],
            names=["word", "times"],
        )
        return outputs, known, base, inside, pa.ListArray.from_arrays(starts, far)


def train(docs: DataFrame, vocabulary: Vocabulary, seed: int = 3) -> bytes:
    """The trained model's parameters. `docs` (id, text) are the training documents; each
    trains once."""
    bounds, weights = vocabulary.outputs()
    packed = Gru(bounds, weights, seed=seed).pack()
    spark = docs.sparkSession
    for number in range(ROUNDS):
        picked = docs.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(ROUNDS)) == number)
        tokens = vocabulary.total // ROUNDS
        trainers = max(1, -(-tokens // TRAINER_TOKENS))
        shared = spark.sparkContext.broadcast((vocabulary, packed))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, start = shared.value
            reader, model, seen, held, size = known.reader, Gru.unpack(start), 0, [], 0
            for batch in small_batches(batches):
                for outputs in reader.outputs(batch.column(0)):
                    held.append(outputs)
                    size += len(outputs)
                    if size >= 2 * TRAINER_TOKENS:
                        seen += model.train(held, known.end)
                        held, size = [], 0
            if held:
                seen += model.train(held, known.end)
            part = TaskContext.get().partitionId()
            if seen:
                columns = [pa.array([part]), pa.array([float(seen)]), pa.array([model.pack()])]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "tokens", "model"])

        schema = "part bigint, tokens double, model binary"
        # In an order of their own, so that a lost trainer's work is repeated exactly.
        ordered = (
            picked.withColumn("deal", F.xxhash64("id", "text"))
            .repartition(int(trainers), "deal")
            .sortWithinPartitions("deal", "id")
        )
        models = materialize(ordered.select("text").mapInArrow(task, schema))
        while (left := models.count()) > 1:
            groups = -(-left // GROUP)
            models = materialize(
                models.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(groups)))
                .groupBy("part")
                .applyInPandas(_averaged, schema)
            )
        found = models.first()
        packed = bytes(found["model"]) if found else packed
    return packed


def _averaged(group):
    import pandas as pd

    mean = Gru.mean(list(group["model"]), list(group["tokens"]))
    return pd.DataFrame(
        {"part": [group["part"].iloc[0]], "tokens": [group["tokens"].sum()], "model": [mean]}
    )


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`<id>`, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    A document's tokens are its words, A-Z folded, and an end. Both scores are logarithms
    to base 10 of the whole text's probability: base_score with words drawn by their smoothed
    counts, score by the model. Null and empty texts are the end alone. Rows without an id
    are never learned from and count as held out; repeated rows stay rows and are counted
    as often. Without training documents every token has probability 1 in the base. An empty
    table gives no rows. Trains when called.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_column, text_column)
    training = source.filter(trains(F.col("id")))
    counts = materialize(count_words(training))
    vocabulary = Vocabulary.of(counts, KNOWN_WORDS, MODEL_WORDS)
    packed = train(training, vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, packed))
    far_type = T.StructType().add("word", T.BinaryType()).add("times", T.LongType())
    schema = T.StructType(
        [
            T.StructField("id", source.schema["id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("near", T.LongType()),
            T.StructField("base", T.DoubleType()),
            T.StructField("model", T.DoubleType()),
            T.StructField("far", T.ArrayType(far_type)),
        ]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parameters = shared.value
        reader, model = known.reader, Gru.unpack(parameters)
        held, texts, size = [], [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            states = model.log_likelihoods(texts, known.end) / np.log(10)
            tokens = np.array([len(t) for t in texts], dtype=np.int64)
            at = 0
            for ids, near, base, inside, far in held:
                part = slice(at, at + len(ids))
                at = part.stop
                columns = [
                    ids, pa.array(tokens[part]), pa.array(near, pa.int64()),
                    pa.array(base), pa.array(inside + states[part]), far,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
            held.clear()
            texts.clear()

        for batch in small_batches(batches):
            outputs, *others = reader.read(batch.column(1))
            held.append((batch.column(0), *others))
            texts += outputs
            size += sum(map(len, outputs))
            if size >= BUFFER_TOKENS:
                yield from flushed()
                size = 0
        if held:
            yield from flushed()

    scored = materialize(
        source.mapInArrow(task, schema).withColumn("row", F.monotonically_increasing_id())
    )
    far = scored.select("row", F.explode("far").alias("f")).select("row", "f.word", "f.times")
    looked_up = (
        far.join(counts.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("logs"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"),
        )
    )
    return scored.drop("far").join(looked_up, "row", "left").select(
        F.col("id").alias(id_column),
        (~trains(F.col("id"))).alias("held_out"),
        "n_tokens",
        (F.col("near") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
