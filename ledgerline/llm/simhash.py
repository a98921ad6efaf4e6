"""Operator 7: SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each padded to the 23 bits of the perfect
binary Golay code. Every segment is within three bits of exactly one codeword, and a
segment one bit away is within four bits of it. Of two fingerprints that differ in at most
four bits, two segments differ in at most one bit each, or one segment is equal and the
other two differ in two bits each (pigeonhole). So

* each fingerprint is filed under three keys (the nearest codewords of two segments) and
  looked up under the codewords within four bits (one or six a segment);
* for the other case it is filed and looked up under an equal segment and the codewords
  within four bits of the next one, which meet at a point between the two.

Looked-up pairs are joined on the key and verified by their bit distance, so no link is
lost. Fingerprints are linked in two steps. First every look-up meets only the smallest
fingerprint under its key, which makes components of dense groups at once; then only
members of different components are compared; where a key holds many, its commonest
component is not compared with itself. A group of many fingerprints that are all alike
therefore costs a few rows a member, not one a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import id_and_text, releasing, small_batches
from ledgerline.llm.hot_join import left_join
from ledgerline.llm.part_ids import text_batches
from ledgerline.llm.components import components
from ledgerline.session import materialize

# The generator of the [23, 12, 7] code, and segments as (first bit, bits).
GENERATOR, LENGTH, MESSAGE = 0xC75, 23, 12
SEGMENTS = ((0, 22), (22, 21), (43, 21))
DISTANCE = 4  # what the keys above find
SEED = 42
FEW = 64  # fingerprints under a key that are compared with every look-up


def fingerprint(text: str, shingle: int = 4, chunk: int = 1 << 14) -> int:
    """The SimHash of a text's word shingles; each bit is set if over half the hashes have it."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    size = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    set_ = np.zeros(64, dtype=np.int64)
    for at in range(0, n, chunk):
        spans = zip(starts[at : min(n, at + chunk)], ends[at + size - 1 :], strict=False)
        hashes = np.array([hashed(joined[a : b - 1], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame,
    shingle: int = 4,
    text_column: str = "text",
    name: str = "fingerprint",
) -> DataFrame:
    """The rows with a bigint column of their texts' fingerprints (bits as in an unsigned
    number). A text without words, empty or null has zero. A column of that name is replaced."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    rows = docs.select(*[docs[c] for c in kept])
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])
    at = kept.index(text_column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, column=at):
            found = [fingerprint(t or "", shingle) for t in batch.column(at).to_pylist()]
            signed = np.array(found, dtype=np.uint64).view(np.int64)
            arrays = [*batch.columns, pa.array(signed)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return rows.mapInArrow(releasing(task), schema)


class Golay:
    """Decoding of 23-bit words to the indices of codewords within four bits."""

    def __init__(self):
        parity = LENGTH - MESSAGE
        self.of_message = np.array(
            [self._remainder(m << parity) for m in range(1 << MESSAGE)], dtype=np.int64
        )
        # The words of up to four bits with each remainder, the lightest first.
        patterns: list[list[int]] = [[] for _ in range(1 << parity)]
        for weight in range(5):
            for bits in combinations(range(LENGTH), weight):
                word = sum(1 << b for b in bits)
                patterns[self._remainder(word)].append(word)
        most = max(map(len, patterns))
        self.patterns = np.array([p + [-1] * (most - len(p)) for p in patterns], dtype=np.int64)

    @staticmethod
    def _remainder(word: int) -> int:
        for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - (LENGTH - MESSAGE))
        return word

    def near(self, words: np.ndarray) -> np.ndarray:
        """Indices of the codewords within four bits, the nearest first, -1 for none."""
        parity = LENGTH - MESSAGE
        remainder = self.of_message[words >> parity] ^ (words & ((1 << parity) - 1))
        errors = self.patterns[remainder]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> parity)


_golay: list[Golay] = []


def _keys(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """Key table (one row per fingerprint), which of its entries exist, whether to file, and
    whether to look up."""
    if not _golay:
        _golay.append(Golay())
    values = prints.view(np.uint64)
    parts = [
        ((values >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        for at, bits in SEGMENTS
    ]
    near = [_golay[0].near(p) for p in parts]
    kind = 0
    for a, b in ((0, 1), (0, 2), (1, 2)):
        tag = np.int64(kind) << 60
        pairs = (near[a][:, :, None] << MESSAGE) | near[b][:, None, :]
        exist = (near[a] >= 0)[:, :, None] & (near[b] >= 0)[:, None, :]
        shape = (len(prints), -1)
        yield tag | pairs[:, 0, 0][:, None], exist[:, 0, 0][:, None], True, False
        yield tag | pairs.reshape(shape), exist.reshape(shape), False, True
        kind += 1
    for equal in range(3):
        fuzzy = near[(equal + 1) % 3]
        tag = np.int64(kind) << 60
        yield tag | (parts[equal][:, None] << MESSAGE) | fuzzy, fuzzy >= 0, True, True
        kind += 1


def _keyed(prints: DataFrame, file: bool) -> DataFrame:
    """`key` beside the columns fp and label: those to file under, or those to look up."""
    schema = "key bigint, fp bigint, label bigint"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096):
            fp, label = (batch.column(i).to_numpy() for i in (0, 1))
            for keys, exist, filed, looked_up in _keys(np.ascontiguousarray(fp)):
                if filed if file else looked_up:
                    row, _ = np.nonzero(exist)
                    columns = [keys[exist], fp[row], label[row]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in columns], names=["key", "fp", "label"]
                    )

    return prints.select("fp", "label").mapInArrow(releasing(task), schema)


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def link(prints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """`fingerprint`, `root` for every different fingerprint: the smallest (as a bigint) that
    is reachable over links of at most four bits. Nulls are left out. Runs jobs when called."""
    distinct = materialize(
        prints.select(F.col(column).alias("fp"))
        .filter(F.col("fp").isNotNull())
        .distinct()
        .withColumn("label", F.col("fp"))
    )
    first = _keyed(distinct, file=True).groupBy("key").agg(F.min("fp").alias("other"))
    stars = (
        _keyed(distinct, file=False)
        .join(first, "key")
        .filter((F.col("fp") != F.col("other")) & _close("fp", "other"))
        .select("fp", "other")
    )
    stars = materialize(stars.distinct())
    labelled = materialize(_labelled(distinct, components(stars, "fp", "other")))

    filed = _keyed(labelled, file=True).withColumnsRenamed({"fp": "other", "label": "other_label"})
    looked_up = _keyed(labelled, file=False)
    under = (
        filed.groupBy("key", "other_label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key")
        .agg(
            F.sum("n").alias("held"),
            F.max(F.struct("n", "other_label")).getField("other_label").alias("major"),
        )
    )
    different = (F.col("label") != F.col("other_label")) & _close("fp", "other")
    filed = filed.join(under, "key")
    few = filed.filter(F.col("held") <= FEW).drop("held", "major")
    many = filed.filter(F.col("held") > FEW)
    # Under a key that holds many, look-ups from outside its commonest component meet all of
    # them, those from inside only what is filed from outside.
    outside = looked_up.join(
        under.filter(F.col("held") > FEW).select("key", "major"), "key"
    ).filter(F.col("label") != F.col("major"))
    others = many.filter(F.col("other_label") != F.col("major")).drop("held", "major")
    ends = ["label", "other_label"]
    cross = (
        looked_up.join(few, "key").filter(different).select(*ends)
        .unionByName(looked_up.join(others, "key").filter(different).select(*ends))
        .unionByName(
            outside.drop("major").join(many.drop("held", "major"), "key")
            .filter(different).select(*ends)
        )
    )
    merged = components(cross.distinct(), "label", "other_label")
    return (
        labelled.join(merged, labelled["label"] == merged["member"], "left")
        .select(F.col("fp").alias("fingerprint"), F.coalesce("root", "label").alias("root"))
    )


def _labelled(distinct: DataFrame, found: DataFrame) -> DataFrame:
    return distinct.join(found, distinct["fp"] == found["member"], "left").select(
        "fp", F.coalesce("root", "fp").alias("label")
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """`<id>`, fingerprint (16 hexadecimal digits), component_id for every row: the smallest
    id of the rows that are reachable over fingerprints at most four bits apart.

    Texts without words have fingerprint zero and link like any other. Rows without an id
    take part; a component of such rows alone has a null id. Repeated rows stay repeated, an
    empty table gives no rows. Runs jobs when called.
    """
    prints = materialize(
        fingerprints(id_and_text(docs, id_column, text_column), shingle).drop("text")
    )
    roots = materialize(link(prints))
    # Every fingerprint's smallest id first: copies are combined before they are shuffled.
    least = (
        prints.groupBy("fingerprint")
        .agg(F.min("id").alias("least"))
        .join(roots, "fingerprint")
        .groupBy("root")
        .agg(F.min("least").alias("component_id"))
    )
    # A group of near copies may hold any share of the fingerprints, a text of the rows.
    named = materialize(left_join(roots, materialize(least), ["root"]).drop("root"))
    return left_join(prints, named, ["fingerprint"]).select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(
    docs: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows, columns unchanged, but one of each group of near-duplicates: the smallest id
    (nulls last), of repeated ids the first row. Runs jobs when called."""
    taken = {c.lower() for c in docs.columns}
    row, print_ = (next(f"{n}{i}" for i in range(99) if f"{n}{i}" not in taken) for n in ("row", "fp"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    staged = materialize(fingerprints(numbered, shingle, text_column, print_))
    prints = staged.select(
        F.col(print_).alias("fingerprint"),
        F.struct(
            F.col(id_column).isNull().alias("missing"), F.col(id_column).alias("id"),
            F.col(row).alias("row"),
        ).alias("place"),
    )
    roots = materialize(link(prints))
    stay = (
        prints.groupBy("fingerprint")
        .agg(F.min("place").alias("place"))
        .join(roots, "fingerprint")
        .groupBy("root")
        .agg(F.min("place").alias("place"))
        .select(F.col("place.row").alias("stays"))
    )
    return staged.join(stay, staged[row] == stay["stays"], "left_semi").select(*docs.columns)
