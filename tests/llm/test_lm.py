"""Language model scoring: counts, base scores, gradients, whole-text likelihoods."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from llm import edge
from pyspark.sql import functions as F

from ledgerline.llm import gru, lm
from ledgerline.llm.common import table


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 1


def check(found, texts):
    """Exact counts and base scores; `texts` are (id, text) rows."""
    words = [(i, (t or "").encode().lower().split() + [b""]) for i, t in texts]
    counts = Counter(w for i, ws in words if not held_out(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    wanted = sorted(
        (
            str(i), held_out(i), len(ws), sum(counts[w] > 0 for w in ws), total,
            round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws), 4),
        )
        for i, ws in words
    )
    assert wanted == sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
        for r in found
    )


@pytest.mark.parametrize("known", [100_000, 40])
def test_table(spark, folder, monkeypatch, known):
    """With few known words most counts come through the join."""
    monkeypatch.setattr(lm, "KNOWN_WORDS", known)
    docs = table(spark, folder, "documents")
    found = lm.score(docs).collect()
    check(found, [(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_odd_rows(spark):
    found = lm.score(edge.docs(spark)).collect()
    check(found, [(i, t) for i, t, *_ in edge.rows()])
    assert lm.score(edge.empty(spark)).collect() == []
    alone = [i for i in range(50) if held_out(i)][:3]
    found = lm.score(edge.docs(spark, data=[(i, "a b", None, None, 3) for i in alone])).collect()
    assert {(r.train_tokens, r.n_known) for r in found} == {(0, 0)}
    assert all(abs(r.base_score) < 1e-9 and r.score < 0 for r in found)


def test_every_training_document_trains_once(spark, folder, monkeypatch):
    """The trainers' tokens, as they are averaged, are those of all training documents."""
    seen = []
    kept = lm.materialize

    def watched(frame):
        found = kept(frame)
        if "model" in found.columns:
            seen.append(sum(r.tokens for r in found.select("tokens").collect()))
        return found

    monkeypatch.setattr(lm, "materialize", watched)
    for docs in (table(spark, folder, "documents"), edge.docs(spark, data=edge.rows()[:3])):
        seen.clear()
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        texts = texts.filter(lm.trains(F.col("id")))
        vocabulary = lm.Vocabulary.of(lm.count_words(texts), 100, 20)
        lm.train(texts, vocabulary)
        assert sum(seen) == sum(len((t or "").encode().split()) + 1 for i, t in rows if not held_out(i))


def small_vocabulary(words):
    counts = Counter(words)
    ordered = sorted(counts, key=lambda w: (-counts[w], w))[:6]
    kinds, kind_words = np.zeros(lm.KINDS), np.zeros(lm.KINDS)
    for w, n in counts.items():
        if w not in ordered[:4]:
            kinds[lm.kind_of(w)] += n
            kind_words[lm.kind_of(w)] += 1
    numbers = np.array([counts[w] for w in ordered], dtype=float)
    return lm.Vocabulary(ordered, numbers, len(words) + 9, len(counts) + 1, 9, kinds, kind_words, 4)


def test_probabilities_sum_to_one():
    """Over all known words, the end, and one unknown word of each kind."""
    words = [w.encode() for w in edge.words(3, 300).lower().split()]
    vocabulary = small_vocabulary(words)
    reader = lm.Reader(vocabulary)
    model = gru.Gru(*vocabulary.outputs(), size=5)
    counts = Counter(words)
    total = 0.0
    unknown = [b"z" * n + mark + extra for n in (1, 6, 10, 15) for mark in (b"", b".") for extra in (b"",)]
    by_kind = {}
    for w in unknown + ["é" * n + m for n in (1, 4, 6, 9) for m in ("", ".")]:
        w = w if isinstance(w, bytes) else w.encode()
        by_kind.setdefault(lm.kind_of(w), w)
    for w in [*counts, *by_kind.values()]:
        outputs, _, _, inside, far = reader.read(w.decode())
        logs = sum(n * math.log10(counts[f] + 0.5) for f, n in far.items())
        state = model.log_likelihoods([outputs[:1]], vocabulary.end)[0] / math.log(10)
        total += 10 ** (state + inside + logs)
    total += math.exp(model.log_likelihoods([np.array([vocabulary.end])], vocabulary.end)[0])
    assert len(by_kind) == lm.KINDS and total == pytest.approx(1.0, rel=1e-4)


def slow_likelihood(model, text, start):
    """One text, step by step."""
    h, before, total = np.zeros(len(model.wh)), start, 0.0
    size = len(h)
    for y in text:
        x = model.embed[before] @ model.wx + model.b
        r_part = h @ model.wh
        z = 1 / (1 + np.exp(-(x[:size] + r_part[:size])))
        r = 1 / (1 + np.exp(-(x[size : 2 * size] + r_part[size : 2 * size])))
        new = np.tanh(x[2 * size :] + r * r_part[2 * size :])
        h = (1 - z) * new + z * h
        c = model.class_of[y]
        a, b = model.bounds[c], model.bounds[c + 1]
        for logits, at in ((h @ model.wc + model.bc, c), (model.wo[a:b] @ h + model.bo[a:b], y - a)):
            total += logits[at] - np.log(np.exp(logits).sum())
        before = y
    return total


@pytest.fixture
def model():
    made = gru.Gru(np.array([0, 3, 7, 8, 9]), np.arange(1.0, 10), size=4)
    for k in gru.Gru.NAMES:
        setattr(made, k, getattr(made, k).astype(np.float64))
    return made


def some_texts(seed, n=40, longest=200):
    random_ = np.random.default_rng(seed)
    return [random_.integers(0, 9, size=int(k)).astype(np.int32) for k in random_.integers(0, longest, n)]


@pytest.mark.parametrize("lanes", [1, 3, 64])
def test_whole_texts_carry_their_state(model, lanes):
    texts = some_texts(1)
    wanted = [slow_likelihood(model, t, 8) for t in texts]
    assert model.log_likelihoods(texts, 8, lanes) == pytest.approx(wanted, rel=1e-6)
    copy = gru.Gru.unpack(model.pack())
    assert copy.log_likelihoods(texts, 8, lanes) == pytest.approx(wanted, rel=1e-6)


@pytest.mark.parametrize("piece", [1, 7, 96])
def test_pieces_change_nothing(model, monkeypatch, piece):
    """Chunks of one step, so that pieces of any size are whole chunks and whole windows."""
    monkeypatch.setattr(gru, "CHUNK", 1)
    monkeypatch.setattr(gru, "WINDOW", 1)
    texts = [*some_texts(4), np.array([], dtype=np.int32)]
    found = []
    for size in (10**6, piece):
        monkeypatch.setattr(gru, "PIECE", size)
        copy = gru.Gru.unpack(model.pack())
        likelihoods = copy.log_likelihoods(texts, 8, 5)
        found.append((likelihoods, copy.train(texts, 8, 3), copy.wh, copy.embed))
    for a, b in zip(*found, strict=True):
        assert np.array_equal(a, b)


def test_memory_does_not_follow_the_longest_text(model):
    """One long text beside many short ones, which as a dense table is 17 bytes a cell."""
    texts = [np.arange(n, dtype=np.int32) % 9 for n in [30_000] + [5] * 255]
    for call in (model.log_likelihoods, model.train):
        tracemalloc.start()
        call(texts, 8)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 17 * 2_000 * 256


def test_a_long_text_leaves_few_lanes_no_windows():
    """A trainer's share and a scoring buffer with a text as long as the longest of sf0.1."""
    for size, lanes in ((lm.TRAINER_TOKENS, 64), (lm.BUFFER_TOKENS, 256)):
        texts = [np.zeros(n, dtype=np.int32) for n in [20_021] + [500] * ((size - 20_021) // 500)]
        steps = [laid.active for laid in gru.Lanes.pieces(texts, 0, lanes)]
        assert np.concatenate(steps).mean() > 0.9 * lanes


def test_a_window_makes_few_products(model, monkeypatch):
    """The embedding's gradient is added up once for all steps of a window."""
    calls = []
    kept = np.matmul
    monkeypatch.setattr(np, "matmul", lambda *a, **k: calls.append(1) or kept(*a, **k))
    monkeypatch.setattr(np, "hstack", lambda *a, **k: pytest.fail("a step's gradients on their own"))
    texts = some_texts(6, 6, 30)
    laid = gru.Lanes.of(texts, 8, 3)
    steps = len(laid.inputs)
    model._window(laid, range(steps), np.zeros((laid.inputs.shape[1], 4)))
    assert 2 * steps <= len(calls) <= 2 * steps + 20


@pytest.mark.parametrize("factor", [1, 100, -100])
def test_logits_of_any_size(model, factor):
    """Beyond the range of exp, too."""
    for k in ("bc", "bo", "wc", "wo"):
        setattr(model, k, getattr(model, k) * factor)
    texts = some_texts(7, 10, 20)
    texts = [np.array([t % 9 for t in text], dtype=np.int32) for text in texts]
    with np.errstate(all="ignore"):
        wanted = [slow_shifted(model, t, 8) for t in texts]
    assert model.log_likelihoods(texts, 8) == pytest.approx(wanted, rel=1e-6)


def slow_shifted(model, text, start):
    """slow_likelihood with shifted logits."""
    h, before, total = np.zeros(len(model.wh)), start, 0.0
    for y in text:
        x, r = model.embed[before] @ model.wx + model.b, h @ model.wh
        z, gate = 1 / (1 + np.exp(-(x[:4] + r[:4]))), 1 / (1 + np.exp(-(x[4:8] + r[4:8])))
        h = z * h + (1 - z) * np.tanh(x[8:] + gate * r[8:])
        c = model.class_of[y]
        a, b = model.bounds[c], model.bounds[c + 1]
        for logits, at in ((h @ model.wc + model.bc, c), (model.wo[a:b] @ h + model.bo[a:b], y - a)):
            total += logits[at] - logits.max() - np.log(np.exp(logits - logits.max()).sum())
        before = y
    return total


def test_reading_many_texts():
    """As words one by one in Python; texts with white space of all kinds, none, none but."""
    import pyarrow as pa

    texts = ["", " \t\n\x0b\f\r ", "A b  a", " ÄB\u00a0c éa Zz. \u2003x", "x" * 20 + "! y\x1cz", "b"] + edge.words(5, 200).split(".")
    batch = pa.array(["left out", *texts]).slice(1)
    words, owners = lm.words_of(batch)
    plain = [t.encode().lower().split() for t in texts]
    assert words.to_pylist() == [w for ws in plain for w in ws]
    assert owners.tolist() == [i for i, ws in enumerate(plain) for _ in ws]
    assert lm.kinds_of(words).tolist() == [lm.kind_of(w) for ws in plain for w in ws]
    assert lm.kinds_of(words.slice(3)).tolist() == [lm.kind_of(w) for ws in plain for w in ws][3:]
    vocabulary = small_vocabulary([w for ws in plain for w in ws])
    reader = vocabulary.reader
    assert reader is vocabulary.reader
    together, alone = reader.read(batch), [reader.read(t) for t in texts]
    for k in range(4):
        for a, b in zip(together[k], [found[k] for found in alone], strict=True):
            assert np.array_equal(a, b)
    for a, b, ws in zip(together[4].to_pylist(), alone, plain, strict=True):
        far = Counter(w for w in ws if w not in vocabulary.words)
        assert {f["word"]: f["times"] for f in a} == far == b[4]
    for a, b in zip(reader.outputs(batch), together[0], strict=True):
        assert np.array_equal(a, b)


def test_rows_that_a_window_does_not_read_go_on(model):
    """As if Adam changed all parameters after every window."""
    random_ = np.random.default_rng(8)
    texts = [np.where(random_.random(40) < 0.02, 5, random_.integers(0, 4, 40)).astype(np.int32) for _ in range(60)]
    plain = gru.Gru.unpack(model.pack())
    model.train(texts, 8, 2)
    moments = {k: (np.zeros_like(getattr(plain, k)), np.zeros_like(getattr(plain, k))) for k in gru.Gru.NAMES}
    h, rounds = np.zeros((2, 4)), 0
    for laid in gru.Lanes.pieces(texts, 8, 2):
        for at in range(0, len(laid.inputs), gru.WINDOW):
            steps = range(at, min(at + gru.WINDOW, len(laid.inputs)))
            h, gradients = plain._window(laid, steps, h[: laid.active[at]])
            rounds += 1
            for k, g in gradients.items():
                m, v = moments[k]
                m += 0.1 * (np.clip(g, -1, 1) - m)
                v += 0.001 * (np.clip(g, -1, 1) ** 2 - v)
                fix = np.sqrt(1 - 0.999**rounds) / (1 - 0.9**rounds)
                held = getattr(plain, k).copy()
                setattr(plain, k, held - 0.02 / (1 + rounds / 400) * fix * m / (np.sqrt(v) + 1e-8))
    assert rounds > 40
    for k in gru.Gru.NAMES:
        assert getattr(model, k) == pytest.approx(getattr(plain, k), abs=1e-4)


def test_gradients(model):
    texts = some_texts(2, 6, 9)
    laid = gru.Lanes.of(texts, 8, 3)
    _, gradients = model._window(laid, range(len(laid.inputs)), np.zeros((laid.inputs.shape[1], 4)))
    n = sum(map(len, texts))
    random_ = random.Random(3)
    for name in gru.Gru.NAMES:
        held = getattr(model, name)
        for _ in range(6):
            at = tuple(random_.randrange(s) for s in held.shape)
            kept, losses = held[at], []
            for step in (1e-5, -1e-5):
                held[at] = kept + step
                losses.append(-model.log_likelihoods(texts, 8).sum() / n)
            held[at] = kept
            assert gradients[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-6)


def test_training_learns_an_order():
    """A sequence with a rule: the untrained model knows frequencies only."""
    random_ = np.random.default_rng(5)
    texts = [(np.arange(60) + random_.integers(0, 9)).astype(np.int32) % 9 for _ in range(400)]
    model = gru.Gru(np.array([0, 3, 6, 9]), np.ones(9), size=12)
    before = model.log_likelihoods(texts[:20], 0).sum()
    for _ in range(4):
        model.train(texts, 0)
    assert model.log_likelihoods(texts[:20], 0).sum() > 0.4 * before


def test_the_mean_of_models(model):
    other = gru.Gru(model.bounds, np.ones(9), size=4, seed=9)
    mean = gru.Gru.unpack(gru.Gru.mean([model.pack(), other.pack()], [3.0, 1.0]))
    assert mean.wh == pytest.approx(0.75 * model.wh + 0.25 * other.wh, abs=1e-6)
