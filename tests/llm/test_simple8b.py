"""Simple-8b: exact round trips of ids and of files."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import edge
from llm.test_packing import TOKENIZER, ids_of

from ledgerline.llm import simple8b


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.integers(0, 64).flatmap(lambda b: st.integers(0, 2**b - 1)), max_size=700),
    st.integers(1, 300),
)
def test_any_ids_come_back(ids, block):
    assert simple8b.decode(simple8b.encode(np.array(ids, dtype=np.uint64), block)).tolist() == ids


@pytest.mark.parametrize("bits", [0, 1, 3, 8, 15, 16, 20, 31, 59, 60, 61, 64])
def test_widths_and_word_counts(bits):
    ids = np.full(1000, (1 << bits) - 1, dtype=np.uint64)
    data = simple8b.encode(ids, block=1000)
    assert (simple8b.decode(data) == ids).all()
    fitting = [c for c, b in zip(simple8b.COUNTS[1:], simple8b.BITS[1:]) if b >= bits]
    words = -(-1000 // int(fitting[0])) if fitting else 2000  # an escape and its exception
    assert len(data) == simple8b.HEADER.size + 8 * (1 + words)


def test_damage_is_noticed():
    data = simple8b.encode(np.arange(100))
    with pytest.raises(ValueError):
        simple8b.decode(b"nope" + data[4:])
    with pytest.raises(ValueError):
        simple8b.decode(data[:-8])


def test_files_of_odd_rows(spark):
    found = simple8b.round_trip(edge.docs(spark), TOKENIZER, end_id=2).collect()
    assert len(found) == len(edge.rows())
    rows = sorted(found, key=lambda r: r.start)
    at = 0
    for r in rows:  # documents follow one another without gaps, in order of id
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    wanted = {}
    for i, t, *_ in edge.rows():
        coded = [*ids_of(t or ""), 2]
        wanted.setdefault(i, []).append((len(coded), simple8b.checksum(coded)))
    for i, expected in wanted.items():
        got = [(r.n_tokens, r.ids_crc32) for r in found if r.doc_id == i]
        assert sorted(got) == sorted(expected)


def test_empty_table(spark):
    assert simple8b.round_trip(edge.empty(spark), TOKENIZER, end_id=2).collect() == []
