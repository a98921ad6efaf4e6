"""Line dedup against the same rules in plain Python."""

import hashlib

import pytest
from llm import edge

import corpus_pipeline
from ledgerline.llm import line_dedup
from ledgerline.llm.common import table
from ledgerline.llm.line_dedup import DIVISOR, FACTOR, MIN_LINES, MIN_WORDS, dedup_lines, dedup_passages


def slow_chunks(text):
    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    found, held = [], []
    for i, line in enumerate(lines):
        held.append(line)
        rolling = hashes[i] * FACTOR + (hashes[i - 1] if i else 0)
        if rolling % DIVISOR == 0 or i == len(lines) - 1:
            found.append(held)
            held = []
    return found


def slow_dedup(texts):
    """`texts` by id: the text left, chunks and lines removed."""
    seen, result = set(), {}
    for i in sorted(texts):
        kept, chunks, lines = [], 0, 0
        for chunk in slow_chunks(texts[i]):
            whole = "\n".join(chunk)
            full = sum(bool(x.strip(" ")) for x in chunk) >= MIN_LINES
            if full and whole in seen:
                chunks, lines = chunks + 1, lines + len(chunk)
                continue
            kept += chunk
            if full:
                seen.add(whole)
        result[i] = ("\n".join(kept), chunks, lines)
    return result


def found_in(df):
    return {r.doc_id: (r.text, r.removed_chunks, r.removed_lines) for r in df.collect()}


def test_table(spark, folder):
    docs = table(spark, folder, "documents")
    texts = {r.doc_id: r.text for r in docs.collect() if r.text is not None}
    found = found_in(dedup_lines(docs))
    wanted = slow_dedup(texts)
    assert {i: f for i, f in found.items() if i in wanted} == wanted
    assert any(chunks for _, chunks, _ in wanted.values())


@pytest.mark.parametrize("size", [6, 40])
def test_a_passage_is_found_wherever_it_stands(spark, size):
    passage = [edge.words(100 + i, 12) for i in range(size)]
    texts = {0: "\n".join(passage)}
    for i in range(1, 12):
        before = [edge.words(1000 + 50 * i + j, 8) for j in range(i)]
        texts[i] = "\n".join([*before, *passage, f"the end of {i}"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = found_in(dedup_lines(docs.repartition(4)))
    assert found == slow_dedup(texts)
    assert found[0] == (texts[0], 0, 0)
    if size == 40:  # all but the chunks at its ends
        assert all(found[i][2] >= size - 14 for i in range(1, 12))


def test_a_very_common_chunk(spark):
    common = "\n".join(edge.words(i, 9) for i in range(30))
    texts = {i: common for i in range(300)} | {i: edge.words(i, 20) for i in range(300, 400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert found_in(dedup_lines(docs.repartition(7))) == slow_dedup(texts)


def test_odd_rows(spark):
    docs = edge.docs(spark)
    cut = dedup_lines(docs)
    assert cut.columns == [*docs.columns, "removed_chunks", "removed_lines"]
    found = cut.collect()
    assert len(found) == len(edge.rows())
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    texts = {i: t for i, t, *_ in edge.rows()}
    assert by_id[0][0].text == texts[0] and by_id[0][0].removed_lines == 0
    assert by_id[1][0].removed_lines > 0 and by_id[1][0].text.startswith("another start")
    assert by_id[2][0].text is None and {r.text for r in by_id[3]} == {""}
    assert {r.text for r in by_id[6]} == {texts[6]} and len(by_id[6]) == 4  # repeated rows stay
    assert by_id[4][0].text == texts[4]
    assert dedup_lines(edge.empty(spark)).collect() == []


def test_many_lines_in_one_text(spark):
    lines = [f"line {i} of a long text" for i in range(20_000)]
    texts = {1: "\n".join(lines), 2: "\n".join(lines[5_000:])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert found_in(dedup_lines(docs)) == slow_dedup(texts)


def slow_passages(texts):
    """The texts left by id: all runs of lines of enough words, and the chunks, are compared."""
    seen, places = set(), []
    for i in sorted(texts):
        lines = texts[i].split("\n")
        sizes = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            places += [
                (i, a, b, "\n".join(lines[a : b + 1]))
                for b in range(a, len(lines))
                if sizes[a] and sizes[b] and sum(sizes[a : b + 1]) >= MIN_WORDS
            ]
        a = 0
        for chunk in slow_chunks(texts[i]):
            if sum(bool(x.strip(" ")) for x in chunk) >= MIN_LINES:
                places.append((i, a, a + len(chunk) - 1, "\n".join(chunk)))
            a += len(chunk)
    gone, first = {i: set() for i in texts}, {}
    for i, a, b, whole in sorted(places):
        if first.setdefault(whole, (i, a)) != (i, a):
            gone[i].update(range(a, b + 1))
    return {
        i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        for i, t in texts.items()
    }


def passages_left(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    cut = corpus_pipeline.drop_repeated_lines(spark, docs.repartition(4), "")
    return {r.doc_id: r.text for r in cut.collect()}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6])
def test_a_passage_of_50_words_goes_to_its_edges(spark, size):
    names = [f"n{j}" for j in range(900)]
    counts = [50 // size + (k < 50 % size) for k in range(size)]
    passage = "\n".join(edge.words(100 + k, n, names) for k, n in enumerate(counts))
    around = {i: (edge.words(2 * i, 8, names), edge.words(2 * i + 1, 8, names)) for i in range(12)}
    texts = {i: f"{a}\n{passage}\n{b}" for i, (a, b) in around.items()}
    found = passages_left(spark, texts)
    assert found == slow_passages(texts)
    assert found == {i: texts[0] if i == 0 else f"{a}\n{b}" for i, (a, b) in around.items()}
    short = {i: t.replace(passage.split(" ", 1)[0] + " ", f"own{i} ") for i, t in texts.items()}
    assert size > 1 or passages_left(spark, short) == short


def test_passages_of_odd_shapes(spark):
    names = [f"n{j}" for j in range(40)]
    pool = [edge.words(i, 1 + 7 * i % 60, names) for i in range(14)] + ["", " "]
    texts = {}
    for i in range(60):
        texts[i] = "\n".join(pool[(i * i + 5 * j * (1 + i % 3)) % len(pool)] for j in range(i % 17))
    texts |= {60: "\n".join(["a b c d e"] * 40), 61: "\n".join(["one"] * 120), 62: texts[16]}
    assert passages_left(spark, texts) == slow_passages(texts)


def test_passages_of_the_table(spark, folder):
    docs = table(spark, folder, "documents")
    texts = {r.doc_id: r.text for r in docs.collect() if r.text is not None}
    assert {r.doc_id: r.text for r in dedup_passages(docs).collect() if r.text is not None} == slow_passages(texts)


def test_passages_of_odd_rows(spark):
    docs = edge.docs(spark)
    found = dedup_passages(docs)
    assert found.columns == docs.columns
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.doc_id, []).append(r.text)
    texts = {i: t for i, t, *_ in edge.rows()}
    assert by_id[1] == ["another start\nand an end"] and by_id[0] == [texts[0]]
    assert by_id[2] == [None] and by_id[6] == [texts[6]] * 4 and by_id[2**40] == [""]
    assert dedup_passages(edge.empty(spark)).collect() == []
    lines = [f"line {i} of a long text" for i in range(20_000)]
    left = passages_left(spark, {1: "\n".join(lines), 2: "\n".join(["own", *lines[5_000:], "end"])})
    assert left[2] == "own\nend"


def test_passages_of_equal_digest_go_only_if_their_bytes_are_equal(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.F, "sha2", lambda column, bits: line_dedup.F.lit("00"))
    one, other = ("\n".join(f"{w}{i} " * 60 for i in range(3)) for w in ("a", "b"))
    docs = spark.createDataFrame(
        [(1, one), (2, other), (3, one), (3, one)], "doc_id bigint, text string"
    )
    found = sorted(tuple(r) for r in line_dedup.dedup_passages(docs).collect())
    first = one.split("\n")[0]
    assert found[:2] == [(1, one), (2, other)]
    # All runs are in one group here, whose first occurrence is the first line of document 1.
    assert found[2:] == [(3, one.removeprefix(f"{first}\n"))] * 2
