"""Operator 4: removal of repeated multi-line chunks with content-defined boundaries.

A text's lines are hashed, and a rolling hash over the last few line hashes decides after
which lines a chunk ends. A boundary depends on those lines alone, so a passage falls into
the same chunks wherever it stands, whatever lines are put before it. Chunks of several
lines are grouped over all documents by hash; of each group the first occurrence stays, and
the others go if their bytes equal it.

The SQL below states that rule, and dedup_lines follows it. Chunks at either end of a passage
are glued to the neighbouring lines, though, and stay. dedup_passages, which the pipeline uses,
removes besides the repeated chunks every run of whole lines of at least MIN_WORDS words that
stands in an earlier place, up to its edges. It compares, at every line, the shortest run from
there on (or up to there) that has so many words: such a run depends on its own lines alone,
and every longer passage is covered by those within it.

Only expressions of Spark are used. Grouping combines on the map side and brings one text
per chunk; a chunk that a third of the documents share meets its occurrences in an
equi-join that adaptive execution may split, and each document collects no more than its
own chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD
from ledgerline.session import materialize

WINDOW = 2
DIVISOR = 3
MIN_LINES = 2
MIN_WORDS = 50  # of a passage that goes whatever stands beside it
FACTOR = 31  # fixed value of the rolling hash


def bound(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def chunk_ends(lines: Column, window: int, divisor: int) -> Column:
    """Numbers (from 1) of the lines after which a chunk ends."""

    def rolling(hashes: Column, i: Column) -> Column:
        # Hashes have 32 bits and the window is short, so the sum stays in 64 bits.
        return sum(
            (
                F.when(i > j, F.element_at(hashes, F.greatest(i - j, F.lit(1))))
                .otherwise(0)
                * FACTOR ** (window - 1 - j)
                for j in range(1, window)
            ),
            F.element_at(hashes, i) * FACTOR ** (window - 1),
        )

    def ends(hashes: Column) -> Column:
        n = F.size(hashes)
        return F.filter(
            F.sequence(F.lit(1), n),
            lambda i: (i == n) | (F.pmod(rolling(hashes, i), F.lit(divisor)) == 0),
        )

    return bound(F.transform(lines, line_hash), ends)


def chunks(text: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Array of chunks, each the array of its lines; concatenated they are the text's lines.

    A chunk ends at the last line and after every line whose rolling hash, the sum of the
    last `window` line hashes times rising powers of 31, is divisible by `divisor`. A null
    text has null chunks, an empty one a chunk with one empty line.
    """

    def cut(lines: Column) -> Column:
        def pieces(at: Column) -> Column:
            def piece(end: Column, j: Column) -> Column:
                start = F.when(j > 0, F.element_at(at, F.greatest(j, F.lit(1)))).otherwise(0)
                return F.slice(lines, start + 1, end - start)

            return F.transform(at, piece)

        return bound(chunk_ends(lines, window, divisor), pieces)

    return F.when(text.isNotNull(), bound(F.split(F.coalesce(text, F.lit("")), "\n", -1), cut))


def eligible(lines: Column, min_lines: int = MIN_LINES) -> Column:
    """Whether a chunk has as many lines that are not blank."""
    return F.size(F.filter(lines, lambda line: F.trim(line) != "")) >= min_lines


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    divisor: int = DIVISOR,
    min_lines: int = MIN_LINES,
) -> DataFrame:
    """The rows of docs with repeated chunks cut from the text, and two counts,
    `removed_chunks` and `removed_lines` (columns of those names are replaced).

    Occurrences are ordered by id (nulls last), then by a hash of the text, then by place;
    the first stays. Rows with the same id and text are one document: what is cut from one
    is cut from all. A null text stays null; a text of which nothing is left is empty. An
    empty table gives no rows. Writes the repeated chunks when called.
    """
    others = [c for c in docs.columns if c not in ("removed_chunks", "removed_lines")]
    source = docs.select(*others)
    place = [F.col("missing"), F.col("id"), F.col("print")]
    keyed = source.select(
        docs[id_column].isNull().alias("missing"),
        docs[id_column].alias("id"),
        F.xxhash64(docs[text_column]).alias("print"),
        F.posexplode(chunks(docs[text_column], window, divisor)).alias("at", "lines"),
    ).filter(eligible(F.col("lines"), min_lines))
    occurrences = keyed.select(
        F.struct(*place, "at").alias("place"), F.array_join("lines", "\n").alias("chunk")
    ).withColumn("hash", F.xxhash64("chunk"))
    firsts = materialize(
        occurrences.groupBy("hash")
        .agg(F.min(F.struct("place", "chunk")).alias("first"), F.max("place").alias("last"))
        .filter(F.col("first.place") != F.col("last"))
        .select("hash", F.col("first.place").alias("kept"), F.col("first.chunk").alias("first"))
    )
    repeats = (
        occurrences.select("hash", "place")
        .join(firsts, "hash")
        .filter(F.col("place") != F.col("kept"))
        .groupBy(F.col("place.id").alias("id"), F.col("place.print").alias("print"))
        .agg(F.collect_set(F.struct(F.col("place.at").alias("at"), "first")).alias("repeats"))
    )
    names = {f"c{i}": c for i, c in enumerate(others)}
    text_name = next(k for k, c in names.items() if c.lower() == text_column.lower())
    id_name = next(k for k, c in names.items() if c.lower() == id_column.lower())
    wide = source.toDF(*names).withColumn("own_print", F.xxhash64(text_name))
    joined = wide.join(
        repeats,
        wide[id_name].eqNullSafe(repeats["id"]) & (wide["own_print"] == repeats["print"]),
        "left",
    )

    def rebuilt(pieces: Column) -> Column:
        def body(gone: Column) -> Column:
            stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), gone)
            return F.struct(
                F.array_join(
                    F.flatten(F.transform(stay, lambda i: F.element_at(pieces, i + 1))), "\n"
                ).alias("text"),
                F.size(gone).cast("bigint").alias("removed_chunks"),
                F.aggregate(
                    gone,
                    F.lit(0).cast("bigint"),
                    lambda n, i: n + F.size(F.element_at(pieces, i + 1)),
                ).alias("removed_lines"),
            )

        same = F.filter(
            F.col("repeats"),
            lambda r: F.array_join(F.element_at(pieces, r["at"] + 1), "\n") == r["first"],
        )
        return bound(F.transform(same, lambda r: r["at"]), body)

    new = F.when(
        F.col("repeats").isNotNull(), bound(chunks(F.col(text_name), window, divisor), rebuilt)
    )
    done = joined.withColumn("new", new)
    return done.select(
        *[
            (F.coalesce("new.text", k) if k == text_name else F.col(k)).alias(c)
            for k, c in names.items()
        ],
        F.coalesce("new.removed_chunks", F.lit(0)).alias("removed_chunks"),
        F.coalesce("new.removed_lines", F.lit(0)).alias("removed_lines"),
    )


def run_bytes(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n").cast("binary")


def _runs_of(wanted: Column):
    """The bytes of the wanted runs of a text's lines, beside their digests and places."""

    def body(lines: Column) -> Column:
        return F.transform(
            wanted,
            lambda w: F.struct(
                w["digest"].alias("digest"),
                w["at"].alias("at"),
                run_bytes(lines, w["at"], w["last"]).alias("whole"),
            ),
        )

    return body


def runs(text: Column, min_words: int = MIN_WORDS) -> Column:
    """Array of (first, last, digest): the runs of a text's lines, numbered from 0, that are
    compared with others: its eligible chunks, and the shortest runs of at least `min_words`
    words that begin, or end, at each line that has words. The digest is the SHA-256 of the
    run's bytes. A null text has null."""

    def of_lines(lines: Column) -> Column:
        def run(first: Column, last: Column) -> Column:
            digest = F.unhex(F.sha2(run_bytes(lines, first, last), 256))
            return F.struct(first.alias("first"), last.alias("last"), digest.alias("digest"))

        def shortest(near: Column) -> Column:
            """The words of the first lines that have enough, and the last one's number."""
            start = F.struct(F.lit(0).alias("words"), F.lit(-1).alias("end"))
            return F.aggregate(
                near,
                start,
                lambda a, x: F.when(a["words"] >= min_words, a).otherwise(
                    F.struct((a["words"] + x["words"]).alias("words"), x["at"].alias("end"))
                ),
            )

        def around(full: Column) -> Column:
            # Every line of `full` has a word, so min_words of them are enough.
            def forward(x: Column, i: Column) -> Column:
                return bound(
                    shortest(F.slice(full, i + 1, F.lit(min_words))),
                    lambda f: F.when(f["words"] >= min_words, run(x["at"], f["end"])),
                )

            def backward(x: Column, i: Column) -> Column:
                start = F.greatest(i + 1 - min_words, F.lit(0))
                # A run that needs its last line is also the one from its first line on.
                return bound(
                    shortest(F.reverse(F.slice(full, start + 1, i - start + 1))),
                    lambda f: F.when(f["words"] - x["words"] >= min_words, run(f["end"], x["at"])),
                )

            return F.concat(F.transform(full, forward), F.transform(full, backward))

        def of_chunks(ends: Column) -> Column:
            def chunk(end: Column, j: Column) -> Column:
                start = F.when(j > 0, F.element_at(ends, F.greatest(j, F.lit(1)))).otherwise(0)
                own = F.slice(lines, start + 1, end - start)
                return F.when(eligible(own), run(start, end - 1))

            return F.transform(ends, chunk)

        counted = F.transform(
            lines,
            lambda line, i: F.struct(
                F.size(F.regexp_extract_all(line, F.lit(WORD), F.lit(0))).alias("words"),
                i.alias("at"),
            ),
        )
        full = F.filter(counted, lambda x: x["words"] > 0)
        found = F.concat(bound(full, around), bound(chunk_ends(lines, WINDOW, DIVISOR), of_chunks))
        return F.filter(found, lambda r: r.isNotNull())

    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.when(text.isNotNull(), bound(lines, of_lines))


def dedup_passages(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """The rows of docs without the lines of repeated passages: of runs of whole lines of at
    least `min_words` words, the first and last not blank, and of the chunks of dedup_lines.

    Places are ordered and rows with the same id and text treated as by dedup_lines; runs meet
    by digest, and a line goes if it lies in a run whose bytes equal those of its digest's
    first occurrence, so each stays once. Where a passage overlaps itself, what repeats goes.
    A null text stays null; a text of which nothing is left is empty. An empty table gives no
    rows. Writes the repeated runs' digests when called.
    """
    occurrences = docs.select(
        docs[id_column].isNull().alias("missing"),
        docs[id_column].alias("id"),
        F.xxhash64(docs[text_column]).alias("print"),
        F.explode(runs(docs[text_column], min_words)).alias("run"),
    ).select(
        F.col("run.digest").alias("digest"),
        F.struct("missing", "id", "print", F.col("run.first").alias("at")).alias("place"),
        F.col("run.last").alias("last"),
    )
    firsts = materialize(
        occurrences.groupBy("digest")
        .agg(F.min(F.struct("place", "last")).alias("first"), F.max("place").alias("most"))
        .filter(F.col("first.place") != F.col("most"))
        .select("digest", F.col("first.place").alias("kept"), F.col("first.last").alias("last"))
    )
    wanted = firsts.groupBy("kept.missing", "kept.id", "kept.print").agg(
        F.collect_list(F.struct("digest", F.col("kept.at").alias("at"), "last")).alias("wanted")
    )
    texts = docs.select(
        docs[id_column].alias("own"), F.xxhash64(docs[text_column]).alias("own_print"),
        docs[text_column].alias("text"),
    )
    # Of a repeated row's texts, one; the place goes along, so firsts are not met again.
    known = (
        texts.join(
            wanted, texts["own"].eqNullSafe(wanted["id"]) & (F.col("own_print") == F.col("print"))
        )
        .select(
            "missing", "id", "print",
            F.explode(bound(F.split("text", "\n", -1), _runs_of(F.col("wanted")))).alias("run"),
        )
        .groupBy(F.col("run.digest").alias("digest"))
        .agg(
            F.min(
                F.struct(F.struct("missing", "id", "print", "run.at").alias("kept"), "run.whole")
            ).alias("first")
        )
        .select("digest", "first.kept", "first.whole")
    )
    repeats = (
        occurrences.join(known, "digest")
        .filter(F.col("place") != F.col("kept"))
        .groupBy(F.col("place.id").alias("id"), F.col("place.print").alias("print"))
        .agg(F.collect_set(F.struct(F.col("place.at").alias("at"), "last", "whole")).alias("repeats"))
    )
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    text_name = next(k for k, c in names.items() if c.lower() == text_column.lower())
    id_name = next(k for k, c in names.items() if c.lower() == id_column.lower())
    wide = docs.toDF(*names).withColumn("own_print", F.xxhash64(text_name))
    joined = wide.join(
        repeats,
        wide[id_name].eqNullSafe(repeats["id"]) & (wide["own_print"] == repeats["print"]),
        "left",
    )

    def left_of(lines: Column) -> Column:
        same = F.filter(
            F.col("repeats"), lambda r: run_bytes(lines, r["at"], r["last"]) == r["whole"]
        )
        gone = F.flatten(F.transform(same, lambda r: F.sequence(r["at"], r["last"])))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n")

    cut = F.when(F.col("repeats").isNotNull(), bound(F.split(text_name, "\n", -1), left_of))
    return joined.select(
        *[
            (F.coalesce(cut, k) if k == text_name else F.col(k)).alias(c)
            for k, c in names.items()
        ]
    )


SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line, n,
         CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS v
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i,
               len(string_split(text, chr(10))) AS n
        FROM documents WHERE text IS NOT NULL)
), ended AS (
  SELECT *, CASE WHEN i = n OR (v * {FACTOR} + coalesce(lag(v) OVER
           (PARTITION BY doc_id ORDER BY i), 0)) % {DIVISOR} = 0 THEN 1 ELSE 0 END AS ends
  FROM lines
), placed AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot
  FROM ended
), chunked AS (
  SELECT doc_id, spot, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS size,
         count(*) FILTER (WHERE trim(line) <> '') AS full_lines
  FROM placed GROUP BY doc_id, spot
), marked AS (
  SELECT *, full_lines >= {MIN_LINES} AND row_number() OVER
           (PARTITION BY chunk, full_lines >= {MIN_LINES} ORDER BY doc_id, spot) > 1 AS gone
  FROM chunked
), rebuilt AS (
  SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY spot) FILTER (WHERE NOT gone), '')
         AS text, count(*) FILTER (WHERE gone) AS removed_chunks,
         CAST(coalesce(sum(size) FILTER (WHERE gone), 0) AS BIGINT) AS removed_lines
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, r.text, coalesce(r.removed_chunks, 0) AS removed_chunks,
       coalesce(r.removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
"""
