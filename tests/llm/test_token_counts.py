"""Token counts equal the library's."""

import random

import pytest
import sentencepiece
from llm import edge

from ledgerline.llm.common import public_tokenizer, table
from ledgerline.llm.token_counts import RankMerger, token_counts

MODEL = public_tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def strange_texts():
    draw = random.Random(4)
    letters = "abcdetheionng  \n▁é日.,|\t\x00"
    made = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 70))) for _ in range(800)]
    made += ["".join(draw.choice("abcdething") for _ in range(draw.randint(100, 700))) for _ in range(30)]
    spaces = ["", " ", "  a  b ", "\n\n", "a\nb c\n", "▁▁x", " lead", "trail ", "a▁b  ▁c"]
    return made + spaces + [t or "" for t in edge.texts()]


@pytest.mark.parametrize("longest", [128, 6])
def test_any_text(library, longest):
    """With a low limit nearly every pre-token takes the way of the long ones."""
    texts = strange_texts()
    merger = RankMerger(MODEL, longest=longest, most=500)
    found = [n for i in range(0, len(texts), 100) for n in merger.count(texts[i : i + 100])]
    assert found == [len(x) for x in library.encode(texts, num_threads=1)]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        RankMerger(str(path))


def test_tables(spark, folder, library):
    docs = table(spark, folder, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts(docs, MODEL).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes) == (n, len(texts[r.doc_id].encode()))
        assert r.over_limit == (n > 4096)


def test_odd_rows(spark, library):
    found = sorted(
        ((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(edge.docs(spark), MODEL).collect())
    )
    assert found == sorted(
        (i is None, i or 0, len((t or "").encode()), len(library.encode(t or "")))
        for i, t, *_ in edge.rows()
    )
    assert token_counts(edge.empty(spark), MODEL).collect() == []
