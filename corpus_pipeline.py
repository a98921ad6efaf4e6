"""A corpus filtered, deduplicated, mixed and packed: five stages over `documents`.

Each stage takes all rows that its predecessor kept, as written to the shared scratch
folder, and all but the last return the columns of its input. Tables may be empty, texts
null or empty, rows repeated and columns added; the operators say what becomes of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import line_dedup, mixing, packing, simhash, toxicity
from ledgerline.llm.common import public_tokenizer, table
from ledgerline.session import discard, scratch_dir, scratch_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose score says that label 1 is less likely than not. Learns from the labels
    of the documents it gets, without those that are held out for testing."""
    labels = table(spark, folder, "labels")
    model = toxicity.fit(docs, labels, ~toxicity.held_out(labels["doc_id"]))
    score = free_name(docs, "score")
    rated = toxicity.score(docs, model, name=score)
    return rated.filter(F.col(score) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the passages and chunks of lines that stand in an earlier one;
    `n_chars` is counted anew."""
    cut = line_dedup.dedup_passages(docs)
    columns = [
        F.length("text").cast(kind).alias(name) if name == "n_chars" else cut[name]
        for name, kind in docs.dtypes
    ]
    return cut.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group, the smallest id."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix of sources uses it, up to three times or not at all."""
    names = {n: free_name(docs, n) for n in ("size", "repeats")}
    mixed = mixing.mix(docs, F.array("source"), names=names)
    times = F.array_repeat(F.lit(0), F.col(names["repeats"]))
    return mixed.rows.withColumn(names["size"], F.explode(times)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of training sequences, with a checksum of their ids."""
    pieces = packing.pack(docs, public_tokenizer("word_bpe_49k.json"), end_id=1)
    return packing.digest(pieces)


def free_name(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Compression lengths, linking over any distance and tokenizers are not SQL; the tests
# compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Apply the stages to `documents`; each stage's rows are written to the shared scratch
    folder before the next one reads them. What a stage staged, and what it read, is deleted
    when its rows are written, so the folder holds one copy of the corpus in the end."""
    docs = table(spark, folder, "documents")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{number}"
        with scratch_scope(spark):
            stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            discard(spark, f"{base}/{number - 1}")
    return STAGES[-1][1](spark, docs, folder)
