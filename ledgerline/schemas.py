"""Named record layouts. Every field is nullable: bad input becomes null, never an error."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

TEXT, INT, LONG, DOUBLE = StringType(), IntegerType(), LongType(), DoubleType()


def layout(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


# The names, order and types of the record layouts below.
SALES = layout(
    transaction_id=TEXT,
    customer_id=TEXT,
    product_id=TEXT,
    quantity=INT,
    unit_price=DOUBLE,
    transaction_date=TEXT,
    region=TEXT,
    product_category=TEXT,
    total_amount=DOUBLE,
)

SALES_EXT = layout(
    transaction_id=TEXT,
    customer_id=TEXT,
    product_id=TEXT,
    quantity=INT,
    unit_price=DOUBLE,
    transaction_date=TEXT,
    transaction_time=TEXT,
    region=TEXT,
    product_category=TEXT,
    customer_segment=TEXT,
    sales_channel=TEXT,
    total_amount=DOUBLE,
)

# Column order of the shipped CSV file; the reader renames category.
SALES_CSV = layout(
    transaction_id=TEXT,
    customer_id=TEXT,
    product_id=TEXT,
    category=TEXT,
    region=TEXT,
    quantity=INT,
    unit_price=DOUBLE,
    total_amount=DOUBLE,
    transaction_date=TEXT,
)

SIMPLE_SALES = layout(
    transaction_id=TEXT, customer_id=TEXT, amount=DOUBLE, date=TEXT, region=TEXT
)

SIMPLE_SALES_CAT = layout(
    transaction_id=TEXT, customer_id=TEXT, amount=DOUBLE, date=TEXT, region=TEXT, category=TEXT
)

PAYMENTS = layout(
    customer_id=LONG,
    transaction_date=TimestampType(),
    amount=DOUBLE,
    category=TEXT,
    payment_method=TEXT,
)

DEMO_SALES = layout(
    date=DateType(),
    region=TEXT,
    product=TEXT,
    sales_amount=DOUBLE,
    quantity=INT,
    customer_id=TEXT,
)

METRICS = layout(category=TEXT, value=DOUBLE, score=DOUBLE)

# The star tables. Naming the types spares a look at file footers before every query.
STAR = {
    "region": layout(r_regionkey=INT, r_name=TEXT),
    "nation": layout(n_nationkey=INT, n_name=TEXT, n_regionkey=INT),
    "customer": layout(
        c_custkey=LONG, c_name=TEXT, c_nationkey=INT, c_acctbal=DOUBLE, c_mktsegment=TEXT
    ),
    "supplier": layout(s_suppkey=LONG, s_name=TEXT, s_nationkey=INT, s_acctbal=DOUBLE),
    "part": layout(
        p_partkey=LONG,
        p_name=TEXT,
        p_brand=TEXT,
        p_type=TEXT,
        p_size=INT,
        p_retailprice=DOUBLE,
    ),
    "orders": layout(
        o_orderkey=LONG,
        o_custkey=LONG,
        o_orderstatus=TEXT,
        o_totalprice=DOUBLE,
        o_orderdate=TimestampNTZType(),
        o_orderpriority=TEXT,
    ),
    "lineitem": layout(
        l_orderkey=LONG,
        l_partkey=LONG,
        l_suppkey=LONG,
        l_linenumber=INT,
        l_quantity=DOUBLE,
        l_extendedprice=DOUBLE,
        l_discount=DOUBLE,
        l_tax=DOUBLE,
        l_returnflag=TEXT,
        l_linestatus=TEXT,
        l_shipdate=TimestampNTZType(),
    ),
    "events": layout(
        event_id=LONG,
        ts=TimestampNTZType(),
        user_id=LONG,
        event_type=TEXT,
        value=DOUBLE,
        props=TEXT,
    ),
}
