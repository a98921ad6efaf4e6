"""The operators of this subpackage as queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    best_fit,
    collocations,
    line_dedup,
    lm,
    mixing,
    packing,
    prefix_trie,
    simhash,
    simple8b,
    syncmers,
    token_counts,
    top_k,
    toxicity,
)
from ledgerline.llm.common import public_tokenizer, table


def op1_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.edited_copies(table(spark, folder, "documents"))


def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return top_k.top_k(rows, F.col("vec_id") % 20 == 0)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return line_dedup.dedup_lines(docs.select("doc_id", "text"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    pieces = packing.pack(docs, public_tokenizer("word_bpe_49k.json"), end_id=1)
    return packing.digest(pieces)


def op6_simple8b(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return simple8b.round_trip(docs, public_tokenizer("word_bpe_49k.json"), end_id=2)


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, F.array("source"))
    sources = mixed.sources("of")
    return mixed.rows.join(sources, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("repeats")).alias("taken"), "source", "repeats",
    )


def op9_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_counts.token_counts(docs, public_tokenizer("piece_bpe_32k.model"))


def op11_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    packed = best_fit.pack(docs, public_tokenizer("byte_bpe_50k.json"), end_id=0)
    return packed.pieces.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.described(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_syncmers": op1_syncmers,
    "op2_top_k": op2_top_k,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_simple8b": op6_simple8b,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_lm": op9_lm,
    "op10_token_counts": op10_token_counts,
    "op11_best_fit": op11_best_fit,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op2_top_k": top_k.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op12_collocations": collocations.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
