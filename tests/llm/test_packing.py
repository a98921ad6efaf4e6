"""Packing: every id lies in one piece, windows are gapless and nearly full."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm import edge

from ledgerline.llm import packing
from ledgerline.llm.common import WordIds, public_tokenizer

TOKENIZER = public_tokenizer("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_cached_words_give_the_librarys_ids():
    texts = [t or "" for t in edge.texts()]
    found = [np.frombuffer(b, "<u4").tolist() for b in WordIds(TOKENIZER).encode(texts)]
    assert found == [ids_of(t) for t in texts]


def test_cache_can_be_cleared():
    words = WordIds(TOKENIZER, most=3)
    texts = [edge.words(i, 20) for i in range(6)]
    for t in texts:
        assert np.frombuffer(words.encode([t])[0], "<u4").tolist() == ids_of(t)


@pytest.mark.parametrize("seed", range(12))
def test_streams_fill_their_windows(seed):
    draw = random.Random(seed)
    lengths = [draw.choice([1, 2, 60, 60, 60, draw.randint(1, 300)]) for _ in range(seed * 40)]
    documents = [(i, bytes(4 * n)) for i, n in enumerate(lengths)]
    windows = list(packing.pack_stream(documents, 100, 1_000))
    fills = [sum(len(p[2]) // 4 for p in w) for w in windows]
    assert sum(fills) == sum(lengths) and max(fills, default=0) <= 100
    assert sum(100 - f for f in fills) < 100  # one window with padding at most
    pieces = defaultdict(list)
    for window in windows:
        for owner, start, ids in window:
            pieces[owner].append((start, len(ids) // 4))
    for owner, found in pieces.items():
        at = 0
        for start, n in sorted(found):
            assert start == at
            at += n
        assert at == lengths[owner]


def test_the_best_multiset_is_found():
    pool = packing.Pool(100)
    for n in (60, 35, 30, 30, 9, 3):
        pool.add((0, 0, bytes(4 * n)))
    counts, total = pool.fullest()
    assert total == 99 and counts == {60: 1, 30: 1, 9: 1}
    best = max(
        s for s in (60 + sum(c) for c in [(35, 3), (30, 9), (30,), (35,), (9, 3), (30, 3)]) if s <= 100
    )
    assert total >= best


def test_equal_lengths_need_no_padding():
    windows = list(packing.pack_stream([(i, bytes(4 * 60)) for i in range(50)], 100, 10**6))
    assert [sum(len(p[2]) // 4 for p in w) for w in windows] == [100] * 30


def test_pieces_of_odd_rows(spark):
    docs = edge.docs(spark)
    found = packing.digest(packing.pack(docs, TOKENIZER, end_id=1)).collect()
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    own = [r for r in edge.rows() if r[0] == 5][0]
    ids = [*ids_of(own[1]), 1]
    for r in (r for r in found if r.doc_id == 5):
        part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids)
    assert sum(r.length for r in found) == sum(len(ids_of(t or "")) + 1 for _, t, *_ in edge.rows())
    assert sorted(r.length for r in found if r.doc_id == 3) == [1, 1]


def test_empty_table(spark):
    assert packing.pack(edge.empty(spark), TOKENIZER, end_id=1).collect() == []
