"""Grouped and global sales summaries.

Each takes sales (a source or a plain frame) and returns a lazy frame. Where two
summaries look alike they differ in rounding, in what happens to a missing key, or in
what an average divides by. "Dropped" means rows without a key are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import rounded
from ledgerline.functions.measures import (
    mean_amount,
    mean_units,
    merge,
    revenue,
    revenue_per_row,
    rounded_mean,
)
from ledgerline.sources.sales import Sales, as_sales, key_facts

Data = Sales | DataFrame


def _known(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull())


# Reports of the sales job


def region_summary(data: Data) -> DataFrame:
    return (
        as_sales(data)
        .tally("region")
        .select(
            "region",
            revenue().alias("total_revenue"),
            mean_amount().alias("avg_order_value"),
            F.col("transactions").alias("order_count"),
            F.col("units").alias("total_quantity"),
            F.round("high", 2).alias("max_order_value"),
            F.round("low", 2).alias("min_order_value"),
        )
        .orderBy(F.col("total_revenue").desc(), "region")
    )


def category_summary(data: Data) -> DataFrame:
    return (
        as_sales(data)
        .tally("product_category")
        .select(
            "product_category",
            revenue().alias("total_revenue"),
            mean_amount().alias("avg_order_value"),
            F.col("transactions").alias("order_count"),
            F.col("units").alias("total_quantity"),
            mean_units().alias("avg_quantity_per_order"),
        )
        .orderBy(F.col("total_revenue").desc(), "product_category")
    )


def top_customers(data: Data, k: int = 50) -> DataFrame:
    return (
        as_sales(data)
        .tally("customer_id")
        .select(
            "customer_id",
            revenue().alias("total_spent"),
            F.col("transactions").alias("transaction_count"),
            mean_amount().alias("avg_order_value"),
            F.col("units").alias("total_items_purchased"),
        )
        .orderBy(F.col("total_spent").desc(), "customer_id")
        .limit(k)
    )


def daily_metrics(data: Data) -> DataFrame:
    """Totals over everything; the processing date is the earliest one present."""
    by_day = as_sales(data).tally("transaction_date")
    return merge(by_day, [], F.min("transaction_date").alias("processing_date")).select(
        F.col("transactions").alias("total_transactions"),
        revenue().alias("total_revenue"),
        mean_amount().alias("avg_transaction_value"),
        F.col("units").alias("total_items_sold"),
        "processing_date",
    )


def _with_facts(sales: Sales, customers: Sequence[str], products: Sequence[str]) -> DataFrame:
    """One row with the totals and the facts about customer and product keys. The two
    families meet only in the sales rows, so each is folded on its own path."""
    goods = key_facts(sales, *products)
    people = key_facts(sales, *customers).select(F.struct("*")).scalar()
    return goods.withColumn("people", people)


def final_counts(data: Data) -> DataFrame:
    """Row total, revenue and distinct keys; a missing key counts as one value."""
    facts = _with_facts(
        as_sales(data), ["customer_id", "region"], ["product_id", "product_category"]
    )
    return facts.select(
        F.col("rows").alias("total_records"),
        revenue().alias("total_revenue"),
        F.col("people.customer_id_values").alias("unique_customers"),
        F.col("product_id_values").alias("unique_products"),
        F.col("people.region_values").alias("unique_regions"),
        F.col("product_category_values").alias("unique_categories"),
    )


# Dated aggregates with missing keys dropped


def region_sales(data: Data) -> DataFrame:
    by_region = _known(as_sales(data).tally("region"), "region")
    return by_region.select(
        "region",
        revenue().alias("total_revenue"),
        mean_amount().alias("avg_order_value"),
        F.col("amounts").alias("order_count"),
        F.col("units").alias("total_quantity"),
    ).orderBy("region")


def category_sales(data: Data) -> DataFrame:
    by_category = _known(as_sales(data).tally("product_category"), "product_category")
    return by_category.select(
        "product_category",
        revenue().alias("total_revenue"),
        mean_amount().alias("avg_order_value"),
        F.col("units").alias("total_quantity"),
    ).orderBy("product_category")


def daily_sales(data: Data) -> DataFrame:
    by_day = _known(as_sales(data).tally("transaction_date"), "transaction_date")
    return by_day.select(
        "transaction_date",
        revenue().alias("daily_revenue"),
        F.col("transactions").alias("transaction_count"),
    ).orderBy("transaction_date")


def processing_summary(data: Data, processing_date: str, digits: int | None = None) -> DataFrame:
    facts = _with_facts(
        as_sales(data), ["customer_id", "region"], ["product_id", "product_category"]
    )
    return facts.select(
        F.lit(processing_date).alias("processing_date"),
        F.col("rows").alias("total_records_processed"),
        revenue(digits).alias("total_revenue"),
        mean_amount(digits).alias("avg_order_value"),
        F.col("people.customer_id_known").alias("unique_customers"),
        F.col("product_id_known").alias("unique_products"),
        F.col("people.region_known").alias("regions_covered"),
        F.col("product_category_known").alias("categories_covered"),
    )


# Segment and channel reports


def _volume(data: Data, key: str) -> DataFrame:
    return as_sales(data).tally(key).select(
        key,
        revenue().alias("total_revenue"),
        F.col("units").alias("total_quantity"),
        F.col("rows").alias("transaction_count"),
        revenue_per_row().alias("avg_order_value"),
    )


def region_analysis(data: Data) -> DataFrame:
    return _volume(data, "region")


def category_analysis(data: Data) -> DataFrame:
    return _volume(data, "product_category")


def segment_analysis(data: Data) -> DataFrame:
    """Revenue per segment and per customer in it; the average divides rounded revenue."""
    by_customer = as_sales(data).tally("customer_segment", "customer_id")
    totals = merge(by_customer, ["customer_segment"], F.count(F.lit(1)).alias("customer_count"))
    return totals.select(
        "customer_segment",
        revenue().alias("total_revenue"),
        "customer_count",
        rounded_mean(revenue(), F.col("customer_count")).alias("avg_customer_value"),
    )


def channel_analysis(data: Data) -> DataFrame:
    return as_sales(data).tally("sales_channel").select(
        "sales_channel",
        revenue().alias("total_revenue"),
        F.col("rows").alias("transaction_count"),
        revenue_per_row().alias("avg_transaction_value"),
    )


def top_group(data: Data, key: str) -> DataFrame:
    """The key with the most revenue, as one row; the smaller key wins a tie."""
    return (
        as_sales(data)
        .tally(key)
        .select(key, revenue().alias("total_revenue"))
        .orderBy(F.col("total_revenue").desc(), key)
        .limit(1)
    )


def top_region(data: Data) -> DataFrame:
    return top_group(data, "region")


def executive_summary(data: Data, processing_date: str) -> DataFrame:
    facts = _with_facts(
        as_sales(data),
        ["customer_id", "region", "customer_segment", "sales_channel"],
        ["product_id", "product_category"],
    )
    return facts.select(
        F.lit(processing_date).alias("processing_date"),
        F.col("rows").alias("total_records_processed"),
        revenue().alias("total_revenue"),
        revenue_per_row().alias("avg_transaction_value"),
        F.col("people.customer_id_values").alias("unique_customers"),
        F.col("product_id_values").alias("unique_products"),
        F.col("people.region_values").alias("regions_covered"),
        F.col("product_category_values").alias("categories_covered"),
        F.col("people.region_top").alias("top_region"),
        F.col("product_category_top").alias("top_category"),
        F.col("people.customer_segment_top").alias("top_segment"),
        F.col("people.sales_channel_top").alias("top_channel"),
    )


# The simple summary


def totals_by(data: Data, key: str, digits: int | None = None) -> DataFrame:
    return as_sales(data).tally(key).select(key, revenue(digits).alias("total_amount"))


def region_breakdown(data: Data, digits: int | None = None) -> DataFrame:
    return totals_by(data, "region", digits)


def customer_totals(data: Data, digits: int | None = None) -> DataFrame:
    return totals_by(data, "customer_id", digits)


def top5_customers(data: Data, k: int = 5, digits: int | None = None) -> DataFrame:
    totals = customer_totals(data, digits)
    return totals.orderBy(F.col("total_amount").desc(), "customer_id").limit(k)


def simple_totals(data: Data, processing_date: str) -> DataFrame:
    return key_facts(as_sales(data), "customer_id").select(
        F.lit(processing_date).alias("processing_date"),
        F.col("rows").alias("total_records_processed"),
        revenue().alias("total_revenue"),
        revenue_per_row().alias("avg_transaction_value"),
        F.col("customer_id_values").alias("unique_customers"),
    )


def simple_summary(data: Data, processing_date: str, digits: int | None = None) -> DataFrame:
    """The simple summary as flat rows (kind, key, value). Folded sales answer all parts
    from one small table."""
    sales = as_sales(data)
    totals = simple_totals(sales, processing_date)
    names = [c for c in totals.columns if c != "processing_date"]
    cells = F.array(
        *[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in names]
    )
    flat = totals.select(F.lit("total").alias("kind"), F.inline(cells))

    def group(kind: str, df: DataFrame, key: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"),
            F.col(key).cast("string").alias("key"),
            F.col("total_amount").alias("value"),
        )

    regions = group("region_breakdown", region_breakdown(sales, digits), "region")
    customers = group("top_customers", top5_customers(sales, digits=digits), "customer_id")
    return flat.unionByName(regions).unionByName(customers)


# Key summaries


def key_summary(data: Data, key: str, digits: int | None = None) -> DataFrame:
    return as_sales(data).tally(key).select(
        F.col(key).cast("string").alias("key"),
        revenue(digits).alias("total_amount"),
        F.col("rows").alias("count"),
        revenue_per_row(digits).alias("average_amount"),
    )


def key_summaries(
    data: Data,
    keys: dict[str, str],
    digits: int | None = None,
    together: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """The key summary of several columns, labelled by name. Columns named `together` share
    one tally, which grouping sets divide, as those of one dimension path should; the others
    are tallied on their own."""
    sales = as_sales(data)
    shared = [list(group) for group in together]
    alone = [[c] for c in keys.values() if not any(c in group for group in shared)]
    names = {c: name for name, c in keys.items()}
    result = None
    for group in [*shared, *alone]:
        fine = sales.tally(*group)
        value = F.coalesce(
            *[F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in group]
        )
        label = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(names[c])) for c in group])
        sums = [F.sum(c).alias(c) for c in ("rows", "amounts", "revenue")]
        part = (
            fine.groupingSets([[F.col(c)] for c in group], *group)
            .agg(label.alias("summary"), value.alias("key"), *sums)
            .select(
                "summary",
                "key",
                revenue(digits).alias("total_amount"),
                F.col("rows").alias("count"),
                revenue_per_row(digits).alias("average_amount"),
            )
        )
        result = part if result is None else result.unionByName(part)
    return result


def grouped_key_summaries(
    df: DataFrame,
    keys: dict[str, str],
    amount: str = "amount",
    digits: int | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """The same from one scan of a flat frame, with one grouping set per key. `within`
    names columns that every set keeps, such as the run date."""
    columns = list(keys.values())

    def of_set(values: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(F.grouping(k) == 0, v) for k, v in values.items()])

    label = of_set({key: F.lit(name) for name, key in keys.items()})
    value = of_set({key: F.col(key).cast("string") for key in columns})
    total = F.sum(amount)
    sets = [[F.col(c) for c in (*within, key)] for key in columns]
    return (
        df.groupingSets(sets, *within, *columns)
        .agg(
            label.alias("summary"),
            value.alias("key"),
            rounded(total, digits).alias("total_amount"),
            F.count(F.lit(1)).alias("count"),
            rounded_mean(total, F.count(F.lit(1)), digits).alias("average_amount"),
        )
        .drop(*columns)
    )


# Filtered analysis


def only_region(data: Data, region: str = "all") -> Sales:
    sales = as_sales(data)
    return sales if region == "all" else sales.where("region", region)


def analysis_summary(
    data: Data, analysis_date: str, region: str = "all", digits: int | None = None
) -> DataFrame:
    by_customer = only_region(data, region).tally("customer_id")
    customers = F.count("customer_id").alias("customers")
    return merge(by_customer, [], customers).select(
        F.lit(analysis_date).alias("analysis_date"),
        F.lit(region).alias("region_filter"),
        revenue(digits).alias("total_sales"),
        F.col("units").alias("total_quantity"),
        F.col("customers").alias("unique_customers"),
        mean_amount(digits).alias("avg_order_value"),
        F.col("rows").alias("records_processed"),
    )


def regional_analysis(data: Data, region: str = "all") -> DataFrame:
    by_customer = only_region(data, region).tally("region", "customer_id")
    customers = F.count("customer_id").alias("customers")
    return _known(merge(by_customer, ["region"], customers), "region").select(
        "region",
        revenue().alias("total_sales"),
        mean_amount().alias("avg_sale"),
        F.col("amounts").alias("sale_count"),
        F.col("units").alias("total_quantity"),
        F.col("customers").alias("unique_customers"),
    )


def product_analysis(data: Data, region: str = "all", product: str = "product_id") -> DataFrame:
    by_product = only_region(data, region).tally(product)
    return _known(by_product, product).select(
        product,
        revenue().alias("total_sales"),
        mean_amount().alias("avg_sale"),
        F.col("units").alias("total_quantity"),
    )


def daily_trend(
    data: Data, region: str = "all", date: str = "transaction_date", digits: int | None = None
) -> DataFrame:
    by_day = _known(only_region(data, region).tally(date), date)
    return by_day.select(date, revenue(digits).alias("sales_amount")).orderBy(date)


def last_days(
    data: Data,
    n: int = 30,
    region: str = "all",
    date: str = "transaction_date",
    digits: int | None = None,
) -> DataFrame:
    trend = daily_trend(data, region, date, digits)
    return trend.orderBy(F.col(date).desc()).limit(n).orderBy(date)


def ranked_sales(
    data: Data,
    key: str,
    ascending: bool = False,
    region: str = "all",
    digits: int | None = None,
) -> DataFrame:
    """Groups ordered by revenue; equal revenue is ordered by key."""
    totals = _known(totals_by(only_region(data, region), key, digits), key)
    measure = F.col("total_amount")
    return totals.orderBy(measure.asc() if ascending else measure.desc(), key)

