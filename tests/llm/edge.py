"""Rows that every operator must handle: nulls, empty and very long texts, repeated rows,
extra columns whose names operators use inside."""

import random

CLASHING = ["id", "size", "fingerprint", "row", "key", "h", "x", "label", "score", "lines", "at"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(seed, n, vocabulary="ab cde fghi jklmn opq rst uvw xyz The of and".split()):
    draw = random.Random(seed)
    return " ".join(draw.choice(vocabulary) for _ in range(n))


def texts():
    lines = [words(i, 9) for i in range(12)]
    return [
        "\n".join(lines),
        "\n".join(["another start", *lines, "and an end"]),
        None,
        "",
        " \n\t \x0b\x0c\r\n ",
        words(1, 40_000),
        words(2, 300),
        words(2, 299) + " zzz",
        "Ünïcödé ßtraße 日本語 \U0001f600 é " * 8,
        "one",
        "a b c",
        "x" * 5_000,
        "<|endoftext|> <|ENDOFTEXT|> <s> </s> ▁ \x00 end",
    ]


def rows():
    found = [
        (i, t, "en", ["s1", "s2", None][i % 3], None if t is None else len(t))
        for i, t in enumerate(texts())
    ]
    repeated = [found[6]] * 3 + [found[3]]
    strange = [
        (None, words(3, 30), None, None, None),
        (None, None, None, None, None),
        (-5, words(3, 30), "de", "", -1),
        (2**40, words(2, 300), "de", "s1", 3),
    ]
    return found + repeated + strange


def docs(spark, clashing=True, data=None):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = spark.createDataFrame(rows() if data is None else data, schema)
    if clashing:
        from pyspark.sql import functions as F

        frame = frame.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return frame


def empty(spark):
    return docs(spark, data=[])
