"""A left join whose left side may have keys that hold a large share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT = 20_000  # keys that are broadcast at most
LEAST_HOT = 1_024  # rows that make a key hot in a small table


def left_join(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """`rows` with the columns of the one row of `table` under its key, or nulls.

    A key is hot above one in `MOST_HOT` of the rows (`LEAST_HOT` of them at least), so there
    are at most `MOST_HOT` hot keys, whatever the input; their rows meet a broadcast copy
    and stay where they are. The others meet in a shuffled join, where no key has more rows
    than that. `rows` is read three times: pass a stored table. Runs one job when called.
    """
    keys = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("rows of key"))
    most = max(LEAST_HOT, rows.count() // MOST_HOT)
    hot = F.broadcast(keys.filter((F.col("rows of key") > most) & present(on)).select(*on))
    hot_table = F.broadcast(table.join(hot, on, "left_semi"))
    columns = [*rows.columns, *[c for c in table.columns if c not in on]]
    common = rows.join(hot, on, "left_semi").join(hot_table, on, "left")
    others = rows.join(hot, on, "left_anti").join(table, on, "left")
    return common.select(*columns).unionByName(others.select(*columns))


def present(columns: list[str]):
    condition = F.lit(True)
    for c in columns:
        condition &= F.col(c).isNotNull()
    return condition
