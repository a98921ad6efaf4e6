"""Toxicity: held-out accuracy, calibration, what may be learned from, odd rows."""

import random
import zlib

import numpy as np
import pytest
from llm import edge
from pyspark.sql import functions as F

from ledgerline.llm import toxicity

SYLLABLES = "an the re on ti er en st ou in ed th ha sh wh es nd at ing ly".split()
STEMS = ["grumbolt", "vexquar", "zylok", "blorvid"]


def made(n, seed=1):
    """Invented prose; every fifth text holds some words on a few odd stems."""
    draw = random.Random(seed)

    def word():
        return "".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 4)))

    rows = []
    for i in range(n):
        words = [word() for _ in range(draw.randint(30, 160))]
        toxic = int(draw.random() < 0.2)
        if toxic:
            for _ in range(max(2, len(words) // 15)):
                words.insert(draw.randint(0, len(words)), draw.choice(STEMS) + draw.choice(SYLLABLES))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = made(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out_texts_are_told_apart(frames):
    docs, labels, truth = frames
    found = toxicity.scored(docs, labels).collect()
    assert len(found) == len(truth)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [r for r in found if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.93
    toxic = [r.score for r in out if truth[r.doc_id]]
    clean = [r.score for r in out if not truth[r.doc_id]]
    ahead = np.mean([[a > b for b in clean] for a in toxic])
    assert ahead > 0.95
    assert abs(np.mean([r.score for r in out]) - np.mean([truth[r.doc_id] for r in out])) < 0.08


def test_held_out_labels_are_not_learned_from(spark, frames):
    docs, labels, _ = frames
    turned = labels.withColumn(
        "toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    first = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    again = {r.doc_id: r.score for r in toxicity.scored(docs.repartition(3), turned).collect()}
    assert first == again  # so reruns agree, too


def test_the_score_is_of_the_text_alone(frames):
    docs, labels, _ = frames
    model = toxicity.fit(docs, labels, ~toxicity.held_out(labels["doc_id"]))
    moved = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    a, b = ([r.score for r in toxicity.score(d, model).orderBy("doc_id").collect()] for d in (docs, moved))
    assert a == b


def test_a_toxic_passage_counts_wherever_it_stands(frames):
    docs, labels, _ = frames
    model = toxicity.fit(docs, labels, F.lit(True))
    clean = " ".join(made(1, seed=9)[0][1].split()[:120])
    bad = " ".join(STEMS * 3)
    for text in (bad + " " + clean, clean + " " + bad, clean + " " + bad + " " + clean):
        assert model.score([text])[0] > 0.5 > model.score([clean])[0]


def test_odd_rows(spark, frames):
    _, labels, _ = frames
    docs = edge.docs(spark)
    strange = spark.createDataFrame([(None, 0, 1), (0, 0, None), (1, 0, 1), (1, 0, 0), (10**9, 0, 1)], labels.schema)
    found = toxicity.scored(docs, labels.unionByName(strange)).collect()
    assert len(found) == len(edge.rows())
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in found)
    assert toxicity.scored(edge.empty(spark), labels).collect() == []
    model = toxicity.fit(docs, labels.limit(0), F.lit(True))
    rated = toxicity.score(docs, model)
    assert set(rated.columns) == set(docs.columns)  # the old column of that name is replaced
    assert {r.score for r in rated.collect()} == {0.0}


def test_thresholds_are_fitted_on_whole_texts(spark, frames, monkeypatch):
    """The last feature tells the number of windows that a text was read in."""
    docs, labels, _ = frames
    longer = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.repeat("text", 12)).otherwise(F.col("text")))
    held = []
    kept = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda x, y: held.append(x) or kept(x, y))
    toxicity.fit(longer, labels, F.lit(True))
    texts = [r.text.split() for r in longer.orderBy("doc_id").collect()]
    windows = [-(-len(words) // toxicity.WINDOW_WORDS) for words in texts]
    assert max(windows) > 100
    assert held[0][:, -1] == pytest.approx([1 / (n + 2) for n in windows])


def test_features_of_clean_texts_do_not_grow_with_length(spark):
    """Clean prose holds a telling word now and then, so long texts hold many."""

    draw = random.Random(8)

    def sprinkled(words):
        return [draw.choice(STEMS) + "an" if draw.random() < 1 / 90 else w for w in words]

    rows = [(i, t if y else " ".join(sprinkled(t.split())), y) for i, t, y in made(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    words = sprinkled(" ".join(t for _, t, y in made(400, seed=4) if not y).split())[:18_000]
    short, long = (
        np.mean([model.features(" ".join(words[i : i + n])) for i in range(0, len(words), n)], axis=0)
        for n in (180, 3_600)
    )
    # A rarity that says nothing is 0.4 on average.
    assert np.all(long < 1.3 * short + [0.4, 0.4, 0.02, 0.02, 0.02, 0])
    assert all(model.score([" ".join(words[:n])])[0] < 0.5 for n in (180, 900, 3_600, 18_000))


@pytest.mark.parametrize("words", [400, 1_000, 8_000, 60_000])
def test_dictionaries_are_trained_at_every_size(words):
    """A frequent word is chosen wherever it stands, not what comes first."""
    draw = random.Random(7)
    rare = ["".join(draw.choice("abcdefghijklm") for _ in range(7)) for _ in range(words)]
    often = [b" " + draw.choice(STEMS).encode() + b"ing" for _ in range(words // 2)]
    samples = [f" {w}".encode() for w in rare] + often
    size = 8_192
    made_ = toxicity.trained(size, [b"".join(samples[i : i + 8]) for i in range(0, len(samples), 8)])
    total = sum(map(len, samples))
    assert len(made_) <= min(size, max(toxicity.LEAST_BYTES, total // toxicity.SAMPLES_X))
    assert sum(stem.encode() in made_ for stem in STEMS) >= 3
    assert not b"".join(samples).startswith(made_)
    assert toxicity.trained(size, [b" a", b" b"]) == b""  # never a prefix of the samples
