"""Operator 3: toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text, and a
text is read in windows of a few words. A window is compressed with the ordinary dictionary
alone and with the toxic one put before it: the bytes that the toxic dictionary saves are
the window's distance. Calibrated thresholds turn a text's distances into a probability: a
logistic curve over the mean and the shares of savings, and over how unlikely the largest and
third largest are among as many windows of ordinary texts, so that length alone raises none.

Most words of a toxic text are ordinary, so the toxic dictionary is trained on those words
only that hold a letter sequence far commoner in toxic examples. A fixed carrier that ends
both dictionaries precedes every window, so that short windows are coded and not stored.

Fitting uses a sample of labelled rows (some EXAMPLES of each class) with their whole texts:
the driver makes the dictionaries, tasks measure the texts; the model is some 60 kB. Scoring
reads every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import id_and_text, releasing
from ledgerline.llm.part_ids import text_batches
from ledgerline.session import materialize

EXAMPLES = 3_000  # labelled rows of each class that a model is fitted on
HASH_PARTS = 1 << 20
WINDOW_WORDS = 8
ORDINARY_BYTES, TOXIC_BYTES = 49_152, 8_192
LETTERS, MARKS, LEAST_Z = 5, 256, 4.5
SAMPLES_X, LEAST_BYTES = 8, 256  # samples are so many times the dictionary; its least size
FOLDS = 3
LEVELS = 16  # savings in bytes that are told apart
CARRIER = b"\x01calibrated carrier that both dictionaries end with, so every block is coded\x02"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def letter_runs(word: str) -> set[str]:
    spaced = " " + word
    return {spaced[i : i + LETTERS] for i in range(max(1, len(spaced) - LETTERS + 1))}


def telling(toxic: list[list[str]], ordinary: list[list[str]]) -> set[str]:
    """The letter sequences whose share of examples is most significantly higher in toxic ones."""
    counts = []
    for examples in (toxic, ordinary):
        seen: Counter = Counter()
        for words in examples:
            seen.update({run for w in set(words) for run in letter_runs(w)})
        counts.append(seen)
    a, b = len(toxic), len(ordinary)

    def z(run: str) -> float:
        p, q = counts[0][run], counts[1][run]
        share = (p + q) / (a + b)
        return (p / a - q / b) / math.sqrt(share * (1 - share) * (1 / a + 1 / b) + 1e-12)

    scored = sorted(((z(run), run) for run, n in counts[0].items() if n >= 3), reverse=True)
    # The more examples there are, the clearer the real ones stand out from chance.
    least = max(LEAST_Z, scored[0][0] / 4) if scored else LEAST_Z
    return {run for score, run in scored[:MARKS] if score > least}


def trained(size: int, samples: list[bytes]) -> bytes:
    """Content of a dictionary trained on the samples, of at most `size` bytes and a fixed part
    of theirs. Where the trainer refuses (a few words, or samples too alike to choose from),
    half the size is asked for, down to LEAST_BYTES; empty if it refuses that too."""
    import zstandard

    size = min(size, max(LEAST_BYTES, sum(map(len, samples)) // SAMPLES_X))
    while True:
        segment = 16 if size < 16_384 else 64
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:
            if size == LEAST_BYTES:
                return b""
            size = max(LEAST_BYTES, size // 2)


def compressor(content: bytes):
    """Function from a window to its compressed length."""
    import zstandard

    content += CARRIER
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=16, chain_log=17, search_log=6, min_match=4, target_length=64,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False,
        write_dict_id=False,
    )
    data.precompute_compress(compression_params=parameters)
    compress = zstandard.ZstdCompressor(dict_data=data, compression_params=parameters).compress
    return lambda window: len(compress(CARRIER + window))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def features_of(saved: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Of a text's windows by saving: rarity of the largest and of the third largest, mean,
    shares of savings of at least two and three bytes, inverse of their number; zeros without
    windows. A rarity is the negative logarithm to base 10 of the probability that as many
    windows of ordinary texts, `tail` their shares, have one (three) of that saving."""
    total = int(saved.sum())
    if not total:
        return np.zeros(6)
    above = np.cumsum(saved[::-1])[::-1]
    rarities = []
    for times in (1, 3):
        level = max(int((above >= times).sum()) - 1, 0)
        expected = total * float(tail[level])
        fewer = sum(expected**k / math.factorial(k) for k in range(times)) * math.exp(-expected)
        exactly = expected**times / math.factorial(times) * math.exp(-expected)
        rarities.append(-math.log10(max(1 - fewer, exactly, 1e-300)))
    n = total + 2
    mean = saved @ np.arange(LEVELS) / n
    return np.array([*rarities, mean, above[2] / n, above[3] / n, 1 / n])


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    tail: np.ndarray | None = None  # shares of ordinary windows that save at least so much
    weights: np.ndarray | None = None  # of the features and a constant
    constant: float = 0.0  # the score where there is nothing to learn from

    def lengths(self):
        if not hasattr(self, "_lengths"):
            self._lengths = (compressor(self.ordinary), compressor(self.toxic + self.ordinary))
        return self._lengths

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lengths"}

    def savings(self, text: str) -> np.ndarray:
        """How many windows of the text save 0 to LEVELS - 1 bytes; none without words."""
        words = words_of(text)
        plain, informed = self.lengths()
        windows = (
            b" " + b" ".join(words[i : i + WINDOW_WORDS])
            for i in range(0, len(words), WINDOW_WORDS)
        )
        saved = np.array([plain(w) - informed(w) for w in windows], dtype=int)
        return np.bincount(np.clip(saved, 0, LEVELS - 1), minlength=LEVELS)

    def features(self, text: str) -> np.ndarray:
        return features_of(self.savings(text), self.tail)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        found = np.array([self.features(t) for t in texts]).reshape(-1, 6)
        return sigmoid(np.column_stack([found, np.ones(len(found))]) @ self.weights)


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve by Newton's method, features scaled for the ridge."""
    scale = features.std(axis=0) + 1e-9
    x = np.column_stack([features / scale, np.ones(len(features))])
    weights = np.zeros(x.shape[1])
    penalty = np.diag([ridge * len(x) / 100] * features.shape[1] + [1e-6])
    for _ in range(50):
        p = sigmoid(x @ weights)
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ weights
        )
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return np.append(weights[:-1] / scale, weights[-1])


def dictionaries(texts: list[str], labels: list[int], seed: int) -> Model:
    """The two dictionaries that examples of both classes give."""
    classes = [
        [t.lower().split() for t, label in zip(texts, labels, strict=True) if label == c]
        for c in (0, 1)
    ]
    marks = telling(classes[1], classes[0])

    def joined(words: list[str], size: int) -> list[bytes]:
        raw = [(" " + w).encode("utf-8", "surrogatepass") for w in words]
        return [b"".join(raw[i : i + size]) for i in range(0, len(raw), size)]

    marked = [w for words in classes[1] for w in words if not marks.isdisjoint(letter_runs(w))]
    random.Random(seed).shuffle(marked)
    ordinary = [s for words in classes[0] for s in joined(words, 60)]
    toxic = joined(marked or [w for words in classes[1] for w in words], 8)
    return Model(trained(ORDINARY_BYTES, ordinary), trained(TOXIC_BYTES, toxic))


def dealt(labels: list[int], seed: int) -> list[int]:
    """The part of each example, of FOLDS, each with as many of either class."""
    order = list(range(len(labels)))
    random.Random(seed).shuffle(order)
    parts = [0] * len(labels)
    for c in (0, 1):
        for place, i in enumerate(i for i in order if labels[i] == c):
            parts[i] = place % FOLDS
    return parts


def measured(examples: DataFrame, parts: dict, models: list[Model]) -> dict:
    """By id, the savings of the examples' whole texts under the model of their part."""
    spark = examples.sparkSession
    shared = spark.sparkContext.broadcast((parts, models))
    id_field = examples.schema["id"]
    schema = T.StructType([id_field, T.StructField("found", T.ArrayType(T.LongType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_of, made = shared.value
        for batch in text_batches(batches):
            ids, texts = (c.to_pylist() for c in batch.columns)
            found = [made[part_of[i]].savings(t) for i, t in zip(ids, texts, strict=True)]
            values = pa.array([f.tolist() for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["id", "found"])

    spread = examples.select("id", "text").repartition(spark.sparkContext.defaultParallelism, "id")
    return {r["id"]: r["found"] for r in spread.mapInArrow(releasing(task), schema).collect()}


def fit_examples(examples: DataFrame, share: float, seed: int = 5) -> Model:
    """A model of the examples (id, label, text; an id once), `share` being the share of toxic
    rows where the classes are sampled unevenly. The thresholds are fitted on distances under
    dictionaries of the other examples (in FOLDS parts), the model's own come from all."""
    rows = sorted(examples.collect(), key=lambda r: r["id"])
    texts, labels = [r["text"] for r in rows], [r["label"] for r in rows]
    if min(labels.count(0), labels.count(1)) < FOLDS:
        return Model(b"", b"", constant=share)
    parts = dealt(labels, seed)
    models = []
    for part in range(FOLDS):
        rest = [i for i, own in enumerate(parts) if own != part]
        models.append(dictionaries([texts[i] for i in rest], [labels[i] for i in rest], seed))
    model = dictionaries(texts, labels, seed)
    if not all(m.ordinary and m.toxic for m in [model, *models]):
        return Model(b"", b"", constant=share)  # too little to train a dictionary on
    found = measured(examples, {r["id"]: p for r, p in zip(rows, parts, strict=True)}, models)
    saved = np.array([found[r["id"]] for r in rows])
    wanted = np.array(labels, dtype=float)
    ordinary = np.cumsum(saved[wanted == 0].sum(axis=0)[::-1])[::-1]
    model.tail = (ordinary + 1) / (ordinary[0] + 1)
    model.weights = logistic(np.array([features_of(s, model.tail) for s in saved]), wanted)
    # Examples are taken class by class; the constant brings back the classes' true odds.
    sampled = wanted.mean()
    model.weights[-1] += math.log(share / (1 - share)) - math.log(sampled / (1 - sampled))
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    examples: int = EXAMPLES,
) -> Model:
    """Fit on labelled rows for which `train`, a condition on the labels' id column, holds.

    Of several labels of an id the highest counts; missing labels and rows without an id are
    passed over. Without examples of both classes the model scores every text with the share
    of toxic labels, 0 without any. Collects some `examples` whole texts of each class: a hash
    of the id picks them, so their number varies by its square root.
    """
    known = (
        labels.filter(train)
        .groupBy(labels[id_column].alias("label_id"))
        .agg(F.max(labels[label_column]).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull())
    )
    counted = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counted.values())
    # A hash picks the share of each class that gives so many, without ranking a class.
    parts = {c: math.ceil(HASH_PARTS * min(1.0, examples / n)) for c, n in counted.items()}
    picked = F.when(F.col("label") == 1, parts.get(1, 0)).otherwise(parts.get(0, 0))
    chosen = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(HASH_PARTS)) < picked)
    source = id_and_text(docs, id_column, text_column)
    # Two classes of some `examples` ids, so every task can have them; other texts stay in place.
    found = materialize(
        source.join(F.broadcast(chosen), source["id"] == chosen["label_id"])
        .groupBy("id", "label")  # of several texts of an id, the first in order
        .agg(F.min("text").alias("text"))
    )
    share = counted.get(1, 0) / total if total else 0.0
    return fit_examples(found, share)


def score(
    docs: DataFrame, model: Model, text_column: str = "text", name: str = "score"
) -> DataFrame:
    """The rows with the probability that the whole text is toxic; a column of that name is
    replaced. A null text is empty; texts without words get the score of no savings."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    rows = docs.select(*[docs[c] for c in kept])
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    at = [c.lower() for c in kept].index(text_column.lower())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, column=at):
            found = model.score([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found)], names=schema.fieldNames()
            )

    return rows.mapInArrow(releasing(task), schema)


def held_out(id_column: Column) -> Column:
    """Rows that are never learned from: the checksum of the id's digits is divisible by 5."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """`<id>`, held_out, score, predicted for every row, from the labels that are not held out.
    A row without an id is scored and counts as not held out. Fits when called."""
    model = fit(docs, labels, ~held_out(labels[id_column]), id_column)
    source = id_and_text(docs, id_column, "text")
    return score(source, model).select(
        F.col("id").alias(id_column),
        F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
