"""The sales data model, as one flat frame or as a star of tables.

Both offer the same two views: `rows(...)`, the line-level frame, and `tally(...)`, the
additive measures per key combination. Operators only need the second, so each source
can choose how to get there.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.columns import nan_to_null
from ledgerline.functions.measures import merge, tally
from ledgerline.session import materialize
from ledgerline.sources.readers import read_star_table


class FlatSales:
    """One denormalised frame, as read from a sales file."""

    def __init__(
        self,
        df: DataFrame,
        transaction: str = "transaction_id",
        amount: str = "total_amount",
        quantity: str = "quantity",
    ):
        self.df = nan_to_null(df)
        self._names = (transaction, amount, quantity)

    def where(self, column: str, value: Any) -> FlatSales:
        return FlatSales(self.df.filter(F.col(column) == F.lit(value)), *self._names)

    def rows(self, *columns: str) -> DataFrame:
        return self.df.select(*columns) if columns else self.df

    def tally(self, *keys: str) -> DataFrame:
        present = set(self.df.columns)

        def column(name: str, kind: str) -> str:
            return f"`{name}`" if name in present else f"cast(null as {kind})"

        transaction, amount, quantity = self._names
        return tally(
            self.df,
            list(keys),
            column(transaction, "string"),
            column(amount, "double"),
            column(quantity, "int"),
        )


# A line is a transaction when both parts of its key are there.
WHOLE_LINE = "case when order_id is not null and line is not null then true end"


class StarSales:
    """Line items with orders, customers, regions and parts around them.

    A tally folds the lines by the foreign key of the next table before joining it, so
    both sides of every shuffled join hold one row per key and a hot key cannot skew it,
    and the aggregation and the join share one exchange. Only the tables that the keys
    need are read. Dimension sizes are not assumed: the planner broadcasts what its own
    size estimate allows and sort-merges the rest.
    """

    # Which columns hang on which table.
    ORDER_COLUMNS = ("customer_id", "transaction_date", "sales_channel")
    CUSTOMER_COLUMNS = ("customer_segment", "region")
    PART_COLUMNS = ("product_category",)

    def __init__(self, spark: SparkSession, folder: str, filters: dict[str, Any] | None = None):
        self.spark = spark
        self.folder = folder
        self.filters = filters or {}

    def where(self, column: str, value: Any) -> StarSales:
        return StarSales(self.spark, self.folder, {**self.filters, column: value})

    def _table(self, name: str) -> DataFrame:
        return read_star_table(self.spark, self.folder, name)

    def _lines(self) -> DataFrame:
        return nan_to_null(
            self._table("lineitem").selectExpr(
                "l_orderkey as order_id",
                "l_linenumber as line",
                "l_partkey as product_id",
                "cast(l_quantity as int) as quantity",
                "try_divide(l_extendedprice, l_quantity) as unit_price",
                "l_extendedprice as total_amount",
            )
        )

    def _orders(self) -> DataFrame:
        orders = self._table("orders")
        day = self.filters.get("transaction_date")
        if day is not None:
            # A range on the stored timestamp reaches the scan; a test on its date does not.
            first = dt.date.fromisoformat(str(day))
            orders = orders.filter(
                f"o_orderdate >= timestamp_ntz '{first}' "
                f"and o_orderdate < timestamp_ntz '{first + dt.timedelta(days=1)}'"
            )
        return orders.selectExpr(
            "o_orderkey as order_id",
            "o_custkey as customer_id",
            "cast(o_orderdate as date) as transaction_date",
            "o_orderpriority as sales_channel",
        )

    def _customers(self) -> DataFrame:
        nations = self._table("nation").join(
            self._table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        customers = self._table("customer").join(
            nations, F.col("c_nationkey") == F.col("n_nationkey"), "left"
        )
        return customers.selectExpr(
            "c_custkey as customer_id", "c_mktsegment as customer_segment", "r_name as region"
        )

    def _parts(self) -> DataFrame:
        return self._table("part").selectExpr(
            "p_partkey as product_id", "p_type as product_category"
        )

    def _filtered(self, df: DataFrame) -> DataFrame:
        for column, value in self.filters.items():
            df = df.filter(F.col(column) == F.lit(value))
        return df

    def rows(self, *columns: str) -> DataFrame:
        """The line-level frame with the named columns (all by default).

        Orders meet customers first, so the lines are shuffled once per foreign key they
        hold themselves and a filter on any dimension shrinks what they meet.
        """
        wanted = {*columns, *self.filters}

        def needs(names: tuple[str, ...]) -> bool:
            return not columns or not wanted.isdisjoint(names)

        df = self._lines().withColumn(
            "transaction_id", F.concat(F.col("order_id"), F.lit("-"), F.col("line"))
        )
        if needs(self.ORDER_COLUMNS + self.CUSTOMER_COLUMNS):
            orders = self._orders()
            if needs(self.CUSTOMER_COLUMNS):
                orders = orders.join(self._customers(), "customer_id", "left")
            df = df.join(orders, "order_id", "left")
        if needs(self.PART_COLUMNS):
            df = df.join(self._parts(), "product_id", "left")
        df = self._filtered(df)
        return df.select(*columns) if columns else df.drop("order_id", "line")

    def tally(self, *keys: str) -> DataFrame:
        wanted = {*keys, *self.filters}
        in_order = wanted & set(self.ORDER_COLUMNS)
        in_customer = wanted & set(self.CUSTOMER_COLUMNS)
        in_part = wanted & set(self.PART_COLUMNS)
        grain = ["order_id"] if in_order or in_customer else []
        grain += ["product_id"] if in_part or "product_id" in wanted else []

        lines = self._lines()
        orders = self._orders() if "order_id" in grain else None
        if "transaction_date" in self.filters:
            lines = lines.join(orders, "order_id", "left_semi")
        folded = tally(lines, grain, WHOLE_LINE, "total_amount", "quantity")
        if orders is not None:
            folded = folded.join(orders, "order_id", "left")
            grain = [k for k in grain if k != "order_id"]
            grain += sorted(in_order | ({"customer_id"} if in_customer else set()))
            folded = merge(folded, grain)
            if in_customer:
                folded = folded.join(self._customers(), "customer_id", "left")
        if in_part:
            folded = folded.join(self._parts(), "product_id", "left")
        folded = self._filtered(folded)
        if grain and set(grain) <= set(keys):
            return folded  # one row per key combination already
        return merge(folded, list(keys))


class FoldedSales:
    """Sales folded once onto families of keys and written out.

    Any keys within one family are answered from its small table, so several reports cost
    one pass over the sales per family instead of one each.
    """

    def __init__(self, families: dict[tuple[str, ...], DataFrame]):
        self.families = families

    def _family(self, keys: tuple[str, ...]) -> DataFrame:
        for family, folded in self.families.items():
            if set(keys) <= set(family):
                return folded
        raise ValueError(f"no family of keys holds {keys}; folded were {list(self.families)}")

    def where(self, column: str, value: Any) -> FoldedSales:
        holding = {f: df for f, df in self.families.items() if column in f}
        if not holding:
            self._family((column,))
        test = F.col(column) == F.lit(value)
        return FoldedSales({f: df.filter(test) for f, df in holding.items()})

    def tally(self, *keys: str) -> DataFrame:
        return merge(self._family(keys), list(keys))


Sales = FlatSales | StarSales | FoldedSales


def fold(data: Sales | DataFrame, *families: tuple[str, ...]) -> FoldedSales:
    sales = as_sales(data)
    return FoldedSales({keys: materialize(sales.tally(*keys)) for keys in families})


def as_sales(data: Sales | DataFrame) -> Sales:
    return FlatSales(data) if isinstance(data, DataFrame) else data


def key_facts(data: Sales, *keys: str) -> DataFrame:
    """One row about several keys and the totals, from one pass over the sales.

    For each key k: `k_values` (distinct values, a missing one included), `k_known` (missing
    left out) and `k_top` (most revenue to the cent, the smaller key on a tie); and the
    measures over everything. Grouping sets expand the tally, never the rows.
    """
    fine = data.tally(*keys)
    sets = [[F.col(k)] for k in keys] + [[]]
    grouped = fine.groupingSets(sets, *keys).agg(
        F.sum("rows").alias("rows"),
        F.sum("amounts").alias("amounts"),
        F.sum("revenue").alias("revenue"),
        *[(F.grouping(k) == 0).alias(f"of_{k}") for k in keys],
    )
    facts = []
    nothing_grouped = F.lit(True)
    for k in keys:
        of_key = F.col(f"of_{k}")
        nothing_grouped = nothing_grouped & ~of_key
        money = F.round("revenue", 2)
        place = F.when(of_key, F.struct(money.isNull(), -money, F.col(k)))
        facts += [
            F.count_if(of_key).alias(f"{k}_values"),
            F.count(F.when(of_key, F.col(k))).alias(f"{k}_known"),
            F.min_by(F.col(k), place).alias(f"{k}_top"),
        ]
    totals = [F.max(F.when(nothing_grouped, F.col(c))) for c in ("rows", "amounts", "revenue")]
    return grouped.agg(
        F.coalesce(totals[0], F.lit(0).cast("bigint")).alias("rows"),
        F.coalesce(totals[1], F.lit(0).cast("bigint")).alias("amounts"),
        totals[2].alias("revenue"),
        *facts,
    )
