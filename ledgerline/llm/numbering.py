"""Numbering the rows of each key in order, without a task that sees all rows of a key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import materialize


def numbered(
    conversations: DataFrame, id_column: str, order: list[str], kept: list[str]
) -> tuple[DataFrame, DataFrame]:
    """The rows with `part` and `at`, and per (`<id>`, `part`) how many rows of the id stand in
    earlier parts (`before`): `before + at` numbers an id's rows from 1 in the given order.

    Rows are dealt by ranges of (id, order, row), so an id with any share of the rows, and any
    number of equal rows, is spread over tasks.
    """
    keys = [id_column, *order, "row number"]
    ordered = (
        conversations.withColumn("row number", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(id_column, *kept)
    )
    schema = T.StructType(
        [*ordered.schema.fields]
        + [T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for key in batch.column(0).to_pylist():
                at = at + 1 if key == last else 1
                last = key
                places.append(at)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([part] * batch.num_rows, pa.int32()),
                    pa.array(places, pa.int64()),
                ],
                names=schema.fieldNames(),
            )

    rows = materialize(ordered.mapInArrow(task, schema))
    sizes = rows.groupBy(id_column, "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(id_column).orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    return rows, materialize(sizes.withColumn("before", before))
