"""Best-fit packing: plans against brute force, ids against the library, whole layouts."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm import edge

from ledgerline.llm import best_fit
from ledgerline.llm.byte_bpe import ByteIds
from ledgerline.llm.common import public_tokenizer
from ledgerline.llm.part_ids import text_batches

TOKENIZER = public_tokenizer("byte_bpe_50k.json")
SIGNS = [
    "a", "b", " ", " ", "\n", "\t", "　", "\xa0", "\x1c", "é", "日", "1", "22", "'s", "'ll", "!",
    "...", "<|endoftext|>", "<|", "́", "\U0001f600", "x" * 30, " " * 5, "\x01", "Ab",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def encoded(encoder, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(pa.array(texts, pa.string()))]


def test_ids_are_the_librarys(library):
    draw = random.Random(3)
    texts = ["".join(draw.choices(SIGNS, k=draw.randint(0, 25))) for _ in range(4000)]
    texts += [t or "" for t in edge.texts()] + ["y" * 9000 + " z", " " * 9000, "a" + " \n" * 5000]
    encoder = ByteIds(TOKENIZER, memory=20_000)  # turns over many times
    found = [i for at in range(0, len(texts), 50) for i in encoded(encoder, texts[at : at + 50])]
    assert found == [ids_of(library, t) for t in texts]


def test_batches_hold_all_rows():
    texts = ["a" * n for n in (5, 0, 300, 1, 2, 99, 100, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["id", "text"])
    cut = list(text_batches([batch, batch.slice(0, 0), batch.slice(3)], most=100))
    assert [i for b in cut for i in b.column(0).to_pylist()] == [*range(9), *range(3, 9)]
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 100 for b in cut)


def used(patterns):
    total = Counter()
    for times, pattern in patterns:
        assert times > 0
        for length, k in pattern.items():
            total[length] += times * k
    return total


@pytest.mark.parametrize("seed", range(40))
def test_plans_use_every_piece_once(seed):
    draw = random.Random(seed)
    capacity = draw.choice([1, 2, 5, 10, 50, 100])
    counts = Counter(draw.randint(1, capacity) for _ in range(draw.randint(0, 400)))
    counts = Counter({v: n * draw.choice([1, 1, 1000]) for v, n in counts.items()})
    patterns = best_fit.plan(counts, capacity)
    assert used(patterns) == counts
    assert all(sum(v * k for v, k in p.items()) <= capacity for _, p in patterns)


def fewest(pieces, capacity):
    """Sequences needed, by trying all."""
    pieces = sorted(pieces, reverse=True)

    def fits(at, room):
        if at == len(pieces):
            return True
        tried = set()
        for i, r in enumerate(room):
            if r >= pieces[at] and r not in tried:
                tried.add(r)
                room[i] -= pieces[at]
                if fits(at + 1, room):
                    return True
                room[i] += pieces[at]
        return False

    return next(n for n in itertools.count() if fits(0, [capacity] * n))


@pytest.mark.parametrize("seed", range(30))
def test_plans_are_near_the_fewest(seed):
    draw = random.Random(seed)
    pieces = [draw.randint(1, 20) for _ in range(draw.randint(1, 9))]
    found = sum(n for n, _ in best_fit.plan(Counter(pieces), 20))
    assert fewest(pieces, 20) <= found <= fewest(pieces, 20) + 1


@pytest.mark.parametrize("seed", range(60))
def test_complements_are_exact_and_found(seed):
    draw = random.Random(seed)
    counts = Counter(draw.randint(1, 30) for _ in range(draw.randint(1, 8)))
    pattern = Counter({draw.choice(list(counts)): 1})
    left = counts - pattern
    stock = best_fit.Stock(counts, 30)
    pieces = sorted(left.elements())
    for gap in range(1, 31):
        sums = [c for k in (1, 2, 3) for c in itertools.combinations(pieces, k) if sum(c) == gap]
        found = stock.complement(gap, pattern)
        if not sums:
            assert found is None
        else:
            assert sum(found) == gap and not Counter(found) - left
            assert len(found) == len(sums[0])


def test_exact_complements_leave_no_gap():
    counts = {1500: 100, 548: 30, 300: 70, 248: 70, 2048: 5, 1000: 3, 24: 6}
    patterns = best_fit.plan(counts, 2048)
    assert sum(n for n, _ in patterns) == 5 + 100 + 2


def test_layout_of_odd_rows(spark, library):
    docs = edge.docs(spark)
    packed = best_fit.pack(docs, TOKENIZER, end_id=0)
    found = packed.pieces.collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert sorted(by_sequence) == list(range(packed.sequence_count))
    texts = defaultdict(list)
    for i, t, *_ in edge.rows():
        texts[i].append([*ids_of(library, t or ""), 0])
    assert {i: sum(r.length for r in p) for i, p in by_doc.items()} == {
        i: sum(map(len, ids)) for i, ids in texts.items()
    }
    for doc in (5, 10, 11, 12):
        (ids,) = texts[doc]
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == 2048 for r in pieces[1:]) and pieces[0].start == 0
        for r in pieces:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids)
    sequences = {r.sequence_id: r.ids for r in packed.sequences().collect()}
    assert sum(map(len, sequences.values())) == sum(r.length for r in found)
    for r in found:
        part = np.array(sequences[r.sequence_id][r.offset : r.offset + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32


def test_one_length_in_many_tasks(spark):
    docs = spark.range(0, 5000, 1, 7).selectExpr("id as doc_id", "'same words here' as text")
    found = best_fit.pack(docs, TOKENIZER, end_id=0, capacity=10).pieces.collect()
    places = {(r.sequence_id, r.offset) for r in found}
    assert len(places) == 5000 and len({s for s, _ in places}) == 2500


def test_empty_table(spark):
    packed = best_fit.pack(edge.empty(spark), TOKENIZER, end_id=0)
    assert packed.pieces.collect() == [] and packed.sequences().collect() == []
