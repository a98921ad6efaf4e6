"""The SQL that each query must agree with, for an engine with ANSI SQL."""

from __future__ import annotations

from ledgerline.plans.queries import (
    BEYOND_DOUBLES,
    DENSE_FAULTS,
    EVENT_RULES,
    EVENT_TYPES,
    ONE_CUSTOMER,
    REGION,
    RUN_DATE,
    SLICE_DATE,
    SPARSE_FAULTS,
)
from ledgerline.sources.generators import (
    CATEGORIES,
    PAYMENT_METHODS,
    REGIONS,
    SIMPLE_CATEGORIES,
)

SALES = """sales as (
  select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as transaction_id,
    o_custkey as customer_id, l_partkey as product_id, cast(l_quantity as integer) as quantity,
    l_extendedprice / l_quantity as unit_price,
    cast(cast(o_orderdate as date) as varchar) as transaction_date,
    r_name as region, p_type as product_category, l_extendedprice as total_amount,
    c_mktsegment as customer_segment, o_orderpriority as sales_channel
  from lineitem
    left join orders on l_orderkey = o_orderkey
    left join customer on o_custkey = c_custkey
    left join nation on c_nationkey = n_nationkey
    left join region on n_regionkey = r_regionkey
    left join part on l_partkey = p_partkey)"""

METRICS = """metrics as (
  select l_returnflag as category, l_extendedprice as value, l_discount as score from lineitem)"""

GAPPY = """gappy as (
  select case when event_id % 101 <> 0 then event_id end as event_id,
    case when event_id % 101 <> 0 and event_id % 71 <> 0 then user_id end as user_id,
    case when event_id % 101 <> 0 and event_id % 89 <> 0 then event_type end as event_type,
    case when event_id % 101 <> 0 and event_id % 97 <> 0 then value end as value
  from events)"""

NOT_EMPTY = """kept as (
  select * from gappy where event_id is not null or user_id is not null
    or event_type is not null or value is not null)"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


GEN_SALES = f"""gen as (
  select printf('TXN_%05d', i) as transaction_id, printf('CUST_%03d', i % 100) as customer_id,
    printf('PROD_%03d', i % 50) as product_id, cast(i % 10 + 1 as integer) as quantity,
    cast(10 as double) + (i * cast(0.5 as double)) % 100 as unit_price,
    '{RUN_DATE}' as transaction_date, {_list(REGIONS)}[i % 4 + 1] as region,
    {_list(CATEGORIES)}[i % 5 + 1] as product_category,
    round(cast(i % 10 + 1 as integer)
      * (cast(10 as double) + (i * cast(0.5 as double)) % 100), 2) as total_amount
  from (select o_orderkey as i from orders))"""

GEN_SIMPLE = f"""gen as (
  select printf('TXN_%05d', i) as transaction_id, printf('CUST_%03d', i % 50) as customer_id,
    cast(10 as double) + i * cast(5.5 as double) as amount, '{RUN_DATE}' as "date",
    {_list(REGIONS)}[i % 4 + 1] as region
  from (select o_orderkey as i from orders))"""

GEN_SIMPLE_CAT = f"""gen as (
  select printf('TXN_%05d', i) as transaction_id, printf('CUST_%03d', i % 100) as customer_id,
    cast(10 as double) + i * cast(2.5 as double) as amount, '{RUN_DATE}' as "date",
    {_list(REGIONS)}[i % 4 + 1] as region, {_list(SIMPLE_CATEGORIES)}[i % 4 + 1] as category
  from (select o_orderkey as i from orders))"""

PAYMENTS = f"""payments as (
  select event_id as id, user_id + 1 as customer_id,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as transaction_date, value as amount,
    event_type as category, {_list(PAYMENT_METHODS)}[event_id % 4 + 1] as payment_method
  from events)"""


def _faulty(period: int) -> str:
    return f"""{PAYMENTS}, broken as (
  select id, customer_id, transaction_date,
    case when id % {period} between 0 and 10 then null
      when id % {period} = 20 then -100.0 else amount end as amount,
    case when id % {period} = 21 then 'InvalidCategory' else category end as category,
    payment_method
  from payments), faulty as (
  select * exclude (id) from broken
  union all select * exclude (id) from broken where id % {period} between 0 and 4)"""


SPARSE = _faulty(SPARSE_FAULTS)
DENSE = _faulty(DENSE_FAULTS)
SOUND = f"{PAYMENTS}, faulty as (select * exclude (id) from payments)"

TESTS = f"""counted as (
  select count(*) as n,
    count(*) filter (where customer_id is null) as m1,
    count(*) filter (where transaction_date is null) as m2,
    count(*) filter (where amount is null) as m3,
    count(*) filter (where category is null) as m4,
    count(*) filter (where payment_method is null) as m5,
    count(*) filter (where amount < 0 or amount > 10000 or customer_id < 1) as bad_range,
    count(*) filter (where category is null or category not in {_in(EVENT_TYPES)}
      or payment_method is null or payment_method not in {_in(PAYMENT_METHODS)}) as bad_value
  from faulty), distincts as (
  select count(*) as d from (select distinct * from faulty)), tests as (
  select n,
    cast(greatest(m1, m2, m3, m4, m5) * 100.0 / n <= {EVENT_RULES.max_missing * 100} as integer)
      + cast((n - d) * 100.0 / n <= {EVENT_RULES.max_duplicates * 100} as integer)
      + cast(bad_range = 0 as integer) + cast(bad_value = 0 as integer) as passed
  from counted, distincts)"""

OVERALL = """select n as total_records,
  case when passed = 4 then 'PASSED' else 'FAILED' end as overall_status,
  4 as total_tests, passed as passed_tests, 4 - passed as failed_tests from tests"""


def _mean(column: str, n: str) -> str:
    """The mean of whole cents, rounded half up to cents in integers."""
    cents = f"cast(round(sum({column}) * 100) as bigint)"
    return f"cast((2 * {cents} + {n}) // (2 * {n}) as double) / 100"


AVG_AMOUNT = _mean("total_amount", "count(total_amount)")
AVG_QUANTITY = _mean("quantity", "count(quantity)")
PER_ROW = _mean("total_amount", "count(*)")


def _sales(select: str) -> str:
    return f"with {SALES}\n{select}"


def _volume(key: str) -> str:
    return _sales(
        f"""select {key}, round(sum(total_amount), 2) as total_revenue,
  cast(sum(quantity) as bigint) as total_quantity, count(*) as transaction_count,
  {PER_ROW} as avg_order_value from sales group by {key}"""
    )


def _key_summary(key: str) -> str:
    return f"""select cast({key} as varchar) as "key", round(sum(total_amount), 2) as total_amount,
  count(*) as "count", {PER_ROW} as average_amount
  from sales group by {key}"""


def _column_stats(name: str) -> str:
    return f"""count({name}) as {name}_count, round(avg({name}), 4) as {name}_avg,
  min({name}) as {name}_min, max({name}) as {name}_max,
  round(stddev_samp({name}), 4) as {name}_stddev"""


def _description(name: str) -> str:
    return f"""select '{name}' as "column", count({name}) as "count",
  round(avg({name}), 4) as mean, round(stddev_samp({name}), 4) as std,
  cast(min({name}) as double) as min,
  round(quantile_cont(cast({name} as double), 0.25), 4) as q25,
  round(quantile_cont(cast({name} as double), 0.5), 4) as median,
  round(quantile_cont(cast({name} as double), 0.75), 4) as q75,
  cast(max({name}) as double) as max from lineitem"""


NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

TOP = """(select {0} from sales group by {0} order by round(sum(total_amount), 2) desc, {0} limit 1)"""

IMPUTED = """select
  coalesce(event_id, (select cast(quantile_disc(event_id, 0.5) as bigint) from {0})) as event_id,
  coalesce(user_id, (select cast(quantile_disc(user_id, 0.5) as bigint) from {0})) as user_id,
  {1} as event_type,
  coalesce(value, (select quantile_disc(value, 0.5) from {0})) as value from {0}"""

GROUPING_SETS = _sales(
    f"""select 'region' as summary, * from ({_key_summary("region")})
  union all select 'category', * from ({_key_summary("product_category")})
  union all select 'customer', * from ({_key_summary("customer_id")})"""
)

def _report_leaves() -> str:
    """Every leaf of the validation report: path, number, text."""
    columns = ["customer_id", "transaction_date", "amount", "category", "payment_method"]
    flag = "case when {0} then 'true' else 'false' end"
    leaves = [("execution_date", None, f"'{RUN_DATE}'"), ("total_records", "n", None)]
    for c in columns:
        leaves.append((f"tests.completeness.missing_data.{c}", f"m_{c}", None))
        leaves.append((f"tests.completeness.missing_percentage.{c}", f"m_{c} * 100.0 / n", None))
    checks = [
        ("validity", "amount_range", "bad_amount"), ("validity", "customer_id", "bad_customer"),
        ("consistency", "category", "bad_category"), ("consistency", "payment_method", "bad_method"),
    ]
    for test, name, count in checks:
        leaves.append((f"tests.{test}.details.{name}.passed", None, flag.format(f"{count} = 0")))
        leaves.append((f"tests.{test}.details.{name}.invalid_count", count, None))
    for test in ("completeness", "uniqueness", "validity", "consistency"):
        leaves.append((f"tests.{test}.passed", None, flag.format(test)))
    leaves += [
        ("tests.uniqueness.total_records", "n", None), ("tests.uniqueness.unique_records", "d", None),
        ("tests.uniqueness.duplicate_count", "n - d", None),
        ("tests.uniqueness.duplicate_percentage", "(n - d) * 100.0 / n", None),
        ("overall_status", None, "case when passed = 4 then 'PASSED' else 'FAILED' end"),
        ("tests_summary.total_tests", "4", None), ("tests_summary.passed_tests", "passed", None),
        ("tests_summary.failed_tests", "4 - passed", None),
    ]
    missing = ", ".join(f"count(*) - count({c}) as m_{c}" for c in columns)
    most = ", ".join(f"m_{c}" for c in columns)
    rows = "\n  union all ".join(
        f"select '{p}' as path, round(cast({n or 'null'} as double), 6) as number, {t or 'null'} as text"
        " from verdicts"
        for p, n, t in leaves
    )
    return f"""with {SPARSE}, facts as (
  select count(*) as n, {missing},
    count(*) filter (where amount < 0 or amount > 10000) as bad_amount,
    count(*) filter (where customer_id < 1) as bad_customer,
    count(*) filter (where category is null or category not in {_in(EVENT_TYPES)}) as bad_category,
    count(*) filter (where payment_method is null
      or payment_method not in {_in(PAYMENT_METHODS)}) as bad_method
  from faulty), distincts as (select count(*) as d from (select distinct * from faulty)),
flags as (select *, greatest({most}) * 100.0 / n <= {EVENT_RULES.max_missing * 100} as completeness,
    (n - d) * 100.0 / n <= {EVENT_RULES.max_duplicates * 100} as uniqueness,
    bad_amount + bad_customer = 0 as validity, bad_category + bad_method = 0 as consistency
  from facts, distincts),
verdicts as (select *, cast(completeness as int) + cast(uniqueness as int) + cast(validity as int)
    + cast(consistency as int) as passed from flags)
{rows}"""


def _exact_description(name: str, value: str, scale: int) -> str:
    """Quartiles in hundredths of the value's last digit, as whole numbers throughout."""

    def text(whole: str, digits: int) -> str:
        if not digits:
            return f"cast({whole} as varchar)"
        part = 10**digits
        return (f"cast({whole} // {part} as varchar) || '.' || "
                f"lpad(cast({whole} % {part} as varchar), {digits}, '0')")  # fmt: skip

    picks = [f"max(case when k = {k} then {text('q', scale + 2)} end) as {n}"
             for k, n in ((1, "q25"), (2, "median"), (3, "q75"))]
    return f"""select '{name}' as "column", any_value(n) as count, any_value({text('lo', scale)}) as min,
  any_value({text('hi', scale)}) as max, {', '.join(picks)} from (
  select k, n, lo, hi, (least_v * 4 + (most_v - least_v) * ((n - 1) * k % 4)) * 25 as q from (
    select k, any_value(n) as n, min(v) filter (i = (n - 1) * k // 4) as least_v,
      min(v) filter (i = ((n - 1) * k + 3) // 4) as most_v, min(v) as lo, max(v) as hi
    from (select {value} as v, row_number() over (order by {value}) - 1 as i, count(*) over () as n
      from orders), (select unnest([1, 2, 3]) as k) group by k))"""


ORACLE: dict[str, str] = {
    "scatter_points": f"with {METRICS}\nselect value, score from metrics",
    "add_lineage": """select event_id, value, '2024-01-01 00:00:00' as processing_timestamp,
  '2024-01-01' as processing_date from events""",
    "incremental_key_summary": GROUPING_SETS,
    "range_violations": f"""with {DENSE}
select * from faulty where amount < 0 or amount > 10000""",
    "disallowed_rows": f"""with {DENSE}
select * from faulty where category is null or category not in {_in(EVENT_TYPES)}""",
    "dq_report": f"""with {SPARSE}, {TESTS}
select '{RUN_DATE}' as execution_date, tests.n as total_records,
  case when passed = 4 then 'PASSED' else 'FAILED' end as overall_status,
  passed as passed_tests, m3 as missing_amounts, d as unique_records
  from tests, counted, distincts""",
    "daily_slice": _sales(
        f"""select transaction_id, customer_id, product_id, quantity, unit_price,
  transaction_date, region, product_category, total_amount
  from sales where transaction_date = '{SLICE_DATE}'"""
    ),
    "profile_range": """select count(*) as total_rows,
  cast(cast(min(o_orderdate) as date) as varchar) as first_value,
  cast(cast(max(o_orderdate) as date) as varchar) as last_value, 6 as total_columns from orders""",
    "distinct_values": _sales(
        """select distinct 'region' as column_name, region as value from sales
  union all select distinct 'product_category', product_category from sales"""
    ),
    "gen_sales": f"with {GEN_SALES}\nselect * from gen",
    "gen_simple_sales": f"with {GEN_SIMPLE}\nselect * from gen",
    "gen_simple_sales_cat": f"with {GEN_SIMPLE_CAT}\nselect * from gen",
    "gen_batch_totals": f"""with {GEN_SALES}
select count(*) as record_count, round(sum(total_amount), 2) as total_revenue from gen""",
    "fault_injection": f"with {SPARSE}\nselect * from faulty",
    "json_document": _volume("region"),
    "derived_amount": _sales(
        """select transaction_id, quantity, unit_price,
  round(quantity * unit_price, 2) as total_amount from sales"""
    ),
    "with_constant": f"""select *, '{RUN_DATE}' as run_date from nation
  order by n_nationkey limit 10""",
    "first_rows": """select n_nationkey, n_name from nation
  union all select n_nationkey, n_name from nation where n_nationkey < 4""",
    "csv_inferred": """select c_custkey, c_name, c_acctbal, c_mktsegment,
  'int, string, double, string' as kinds from customer""",
    "dated_csv": """select case when o_orderkey % 7 <> 0
    then cast(cast(o_orderdate as date) as varchar) end as day, count(*) as orders
  from orders group by 1""",
    "run_slice": f"""select o_orderkey, o_custkey, o_totalprice from orders
  where strftime(o_orderdate, '%Y-%m') = '{SLICE_DATE[:7]}'""",
    "outputs_by_region": """with wanted as (
  select r_name as name from region union all select 'ATLANTIS')
select 'r_name=' || name as expected, count(r_name) > 0 as exists, count(r_name) > 0 as has_files
from wanted left join region on name = r_name group by name""",
    "companion_stats": """select count(*) as l_quantity_count, min(l_quantity) as l_quantity_min,
  max(l_quantity) as l_quantity_max, count(l_tax) as l_tax_count, min(l_tax) as l_tax_min,
  max(l_tax) as l_tax_max, round(avg(l_quantity), 4) as l_quantity_avg,
  round(stddev(l_quantity), 4) as l_quantity_stddev, round(avg(l_tax), 4) as l_tax_avg,
  round(stddev(l_tax), 4) as l_tax_stddev from lineitem""",
    "final_counts_over_runs": _sales(
        """select count(*) as total_records, round(sum(total_amount), 2) as total_revenue,
  (select count(*) from (select distinct customer_id from sales)) as unique_customers,
  (select count(*) from (select distinct product_id from sales)) as unique_products,
  (select count(*) from (select distinct region from sales)) as unique_regions,
  (select count(*) from (select distinct product_category from sales)) as unique_categories
  from sales"""
    ),
    "distinct_over_runs": _sales(
        """select coalesce(period, 'all') as period, unnest(['customer_id', 'product_id']) as name,
  unnest([customers, products]) as known from (
    select substr(transaction_date, 1, 4) as period, count(distinct customer_id) as customers,
      count(distinct product_id) as products from sales
    group by grouping sets ((substr(transaction_date, 1, 4)), ()))"""
    ),
    "quantiles_over_runs": " union all ".join(
        f"""select '{c}' as name, '{q}' as quantile, count({c}) as known,
  round(quantile_cont(cast({c} as double), {p}), 4) as exact, true as within from lineitem"""
        for c in ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
        for q, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))
    ),
    "impute_median_default": f"""with {GAPPY}
select count(*) as total_rows, 0 as still_missing, true as one_value,
  count(*) - count(value) as gaps, true as near_the_middle from gappy""",
    "run_files": """select strftime(o_orderdate, '%Y-%m') as run, true as expected, true as exists,
  count(*) as rows, min(o_orderkey) as least, max(o_orderkey) as greatest, true as gapless,
  true as sized from orders group by 1
union all select strftime(max(o_orderdate) + interval 1 month, '%Y-%m'), true, false, 0, null, null,
  null, null from orders""",
    "recent_runs": """select distinct year(o_orderdate) as year from orders
  order by year desc limit 2""",
    "bad_lines": _sales(
        """select count(*) as lines, count_if(customer_id % 40 = 0) as rejected,
  count_if(customer_id % 40 = 0 or region is null) as without_region,
  count_if(customer_id % 40 = 0) as set_apart, count_if(customer_id % 40 <> 0) as total_records,
  round(sum(total_amount) filter (customer_id % 40 <> 0), 2) as total_revenue,
  count(distinct customer_id) filter (customer_id % 40 <> 0) as unique_customers from sales"""
    ),
    "daily_job": _sales(
        f"""select 'sales-by-region' as report, region as key, round(sum(total_amount), 2) as revenue,
    count(*) as n from day group by region
  union all select 'sales-by-category', product_category, round(sum(total_amount), 2),
    cast(sum(quantity) as bigint) from day group by product_category
  union all select 'daily-sales', transaction_date, round(sum(total_amount), 2), count(*)
    from day group by transaction_date
  union all select 'summary', '', round(sum(total_amount), 2), count(distinct customer_id)
    from day""",
    ).replace(
        "select 'sales-by-region'",
        f", day as (select * from sales where transaction_date = '{SLICE_DATE}')\nselect 'sales-by-region'",
        1,
    ),
    "bucketed_customers": _sales(
        """select customer_id, round(sum(total_amount), 2) as total_amount
  from sales group by customer_id"""
    ),
    "lines_of_a_run": f"""select strftime(o_orderdate, '%Y-%m') as run,
  cast(cast(o_orderdate as date) as varchar) as day, count(*) as lines,
  round(sum(l_extendedprice), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey
  where strftime(o_orderdate, '%Y-%m') in (
    select strftime(o_orderdate, '%Y-%m') from orders where o_custkey = {ONE_CUSTOMER}) group by 1, 2""",
    "footer_profile": """select count(*) as total_rows, min(o_orderkey) as first_value,
  max(o_orderkey) as last_value from orders""",
    "typed_report": _report_leaves(),
    "describe_exact": _exact_description("whole", f"cast(o_orderkey as hugeint) + {BEYOND_DOUBLES}", 0)
    + "\nunion all " + _exact_description(
        "money", "cast(o_orderkey as hugeint) * 100 + 1234567890123456789012", 2
    ),
    "guarded_orders": """select o_orderstatus, count(*) as orders from orders group by o_orderstatus""",
    "no_numbers": "select c_name from customer where false",
    "created_input": """select o_custkey, count(*) as orders from orders group by o_custkey""",
    "sampled_points": """select l_extendedprice, l_discount from lineitem where cast('0x' || substr(md5(
  '42|' || cast(l_orderkey as varchar) || '|' || cast(l_linenumber as varchar)), 1, 8) as bigint)
  < cast(round(0.05 * 4294967296) as bigint)""",
    "sampled_rows": """select o_orderkey, o_totalprice from orders order by cast('0x' || substr(md5(
  '42|' || cast(o_orderkey as varchar)), 1, 8) as bigint), o_orderkey limit 500""",
    "null_injection": f"""with {PAYMENTS}, made as (
  select category, id, cast('0x' || substr(md5('42amount|' || cast(id as varchar)), 1, 8) as bigint)
    < cast(round(0.1 * 4294967296) as bigint) as blank from payments)
select category, count(*) as total_rows, count(*) filter (blank) as blanked,
  cast(sum(id) filter (blank) as bigint) as blanked_ids from made group by category""",
    "impute_median_bigint": f"""with big as (
  select o_orderkey, case when o_orderkey % 5 <> 0 then o_orderkey + {BEYOND_DOUBLES} end as value
  from orders)
select o_orderkey, coalesce(value, (select quantile_disc(value, 0.5) from big)) as value from big""",
    "impute_median_decimal": """with big as (
  select o_orderkey, case when o_orderkey % 5 <> 0 then cast('12345678901234567890.12'
    as decimal(30,2)) + cast(o_orderkey as decimal(19,0)) end as value from orders), ranked as (
  select value, row_number() over (order by value) as n, count(*) over () as total
  from big where value is not null), middle as (
  select value from ranked where n = (total + 1) // 2)
select o_orderkey, cast(cast(coalesce(value, (select value from middle)) as decimal(30,2))
  as varchar) as value from big""",
    "region_filter": _sales(
        f"""select transaction_id, customer_id, region, transaction_date, total_amount
  from sales where region = '{REGION}'"""
    ),
    "drop_all_null": f"with {GAPPY}, {NOT_EMPTY}\nselect * from kept",
    "impute_median": f"with {GAPPY}\n" + IMPUTED.format("gappy", "event_type"),
    "fill_unknown": f"""with {GAPPY}
select event_id, user_id, coalesce(event_type, 'Unknown') as event_type, value from gappy""",
    "clean": f"with {GAPPY}, {NOT_EMPTY}\n"
    + IMPUTED.format("kept", "coalesce(event_type, 'Unknown')"),
    "region_summary": _sales(
        f"""select region, round(sum(total_amount), 2) as total_revenue,
  {AVG_AMOUNT} as avg_order_value, count(transaction_id) as order_count,
  cast(sum(quantity) as bigint) as total_quantity,
  round(max(total_amount), 2) as max_order_value,
  round(min(total_amount), 2) as min_order_value from sales group by region"""
    ),
    "category_summary": _sales(
        f"""select product_category, round(sum(total_amount), 2) as total_revenue,
  {AVG_AMOUNT} as avg_order_value, count(transaction_id) as order_count,
  cast(sum(quantity) as bigint) as total_quantity,
  {AVG_QUANTITY} as avg_quantity_per_order from sales group by product_category"""
    ),
    "top_customers": _sales(
        f"""select customer_id, round(sum(total_amount), 2) as total_spent,
  count(transaction_id) as transaction_count, {AVG_AMOUNT} as avg_order_value,
  cast(sum(quantity) as bigint) as total_items_purchased
  from sales group by customer_id order by total_spent desc, customer_id limit 50"""
    ),
    "daily_metrics": _sales(
        f"""select count(transaction_id) as total_transactions,
  round(sum(total_amount), 2) as total_revenue, {AVG_AMOUNT} as avg_transaction_value,
  cast(sum(quantity) as bigint) as total_items_sold, min(transaction_date) as processing_date
  from sales"""
    ),
    "final_counts": _sales(
        """select count(*) as total_records, round(sum(total_amount), 2) as total_revenue,
  (select count(*) from (select distinct customer_id from sales)) as unique_customers,
  (select count(*) from (select distinct product_id from sales)) as unique_products,
  (select count(*) from (select distinct region from sales)) as unique_regions,
  (select count(*) from (select distinct product_category from sales)) as unique_categories
  from sales"""
    ),
    "numeric_stats": "select " + ", ".join(_column_stats(c) for c in NUMBERS) + " from lineitem",
    "frame_summary": """select count(*) as total_rows, 11 as total_columns, 8 as numeric_columns
  from lineitem""",
    "region_sales": _sales(
        f"""select region, round(sum(total_amount), 2) as total_revenue,
  {AVG_AMOUNT} as avg_order_value, count(total_amount) as order_count,
  cast(sum(quantity) as bigint) as total_quantity
  from sales where region is not null group by region"""
    ),
    "category_sales": _sales(
        f"""select product_category, round(sum(total_amount), 2) as total_revenue,
  {AVG_AMOUNT} as avg_order_value, cast(sum(quantity) as bigint) as total_quantity
  from sales where product_category is not null group by product_category"""
    ),
    "daily_sales": _sales(
        """select transaction_date, round(sum(total_amount), 2) as daily_revenue,
  count(transaction_id) as transaction_count
  from sales where transaction_date is not null group by transaction_date"""
    ),
    "processing_summary": _sales(
        f"""select '{RUN_DATE}' as processing_date, count(*) as total_records_processed,
  round(sum(total_amount), 2) as total_revenue, {AVG_AMOUNT} as avg_order_value,
  count(distinct customer_id) as unique_customers, count(distinct product_id) as unique_products,
  count(distinct region) as regions_covered,
  count(distinct product_category) as categories_covered from sales"""
    ),
    "region_analysis": _volume("region"),
    "category_analysis": _volume("product_category"),
    "segment_analysis": _sales(
        """select customer_segment, round(sum(spent), 2) as total_revenue,
  count(*) as customer_count, round(round(sum(spent), 2) / count(*), 2) as avg_customer_value
  from (select customer_segment, customer_id, sum(total_amount) as spent
    from sales group by customer_segment, customer_id) group by customer_segment"""
    ),
    "channel_analysis": _sales(
        f"""select sales_channel, round(sum(total_amount), 2) as total_revenue,
  count(*) as transaction_count, {PER_ROW} as avg_transaction_value
  from sales group by sales_channel"""
    ),
    "executive_summary": _sales(
        f"""select '{RUN_DATE}' as processing_date, count(*) as total_records_processed,
  round(sum(total_amount), 2) as total_revenue,
  {PER_ROW} as avg_transaction_value,
  count(distinct customer_id) as unique_customers, count(distinct product_id) as unique_products,
  count(distinct region) as regions_covered,
  count(distinct product_category) as categories_covered,
  {TOP.format("region")} as top_region, {TOP.format("product_category")} as top_category,
  {TOP.format("customer_segment")} as top_segment, {TOP.format("sales_channel")} as top_channel
  from sales"""
    ),
    "region_breakdown": _sales(
        "select region, round(sum(total_amount), 2) as total_amount from sales group by region"
    ),
    "customer_totals": _sales(
        """select customer_id, round(sum(total_amount), 2) as total_amount
  from sales group by customer_id"""
    ),
    "top5_customers": _sales(
        """select customer_id, round(sum(total_amount), 2) as total_amount
  from sales group by customer_id order by total_amount desc, customer_id limit 5"""
    ),
    "simple_summary": _sales(
        f"""select 'total' as kind, 'total_records_processed' as "key",
    cast(count(*) as double) as value from sales
  union all select 'total', 'total_revenue', round(sum(total_amount), 2) from sales
  union all select 'total', 'avg_transaction_value', {PER_ROW} from sales
  union all select 'total', 'unique_customers', cast(count(distinct customer_id) as double) from sales
  union all select 'region_breakdown', region, round(sum(total_amount), 2) from sales group by region
  union all select * from (select 'top_customers', cast(customer_id as varchar),
    round(sum(total_amount), 2) as spent from sales group by customer_id
    order by spent desc, customer_id limit 5)"""
    ),
    "regional_key_summary": _sales(_key_summary("region")),
    "category_key_summary": _sales(_key_summary("product_category")),
    "customer_key_summary": _sales(_key_summary("customer_id")),
    "key_summary_all": GROUPING_SETS,
    "key_summary_grouping_sets": GROUPING_SETS,
    "category_stats": f"""with {METRICS}
select category, round(avg(value), 4) as value_mean, round(stddev_samp(value), 4) as value_std,
  count(value) as value_count, round(avg(score), 4) as score_mean,
  round(stddev_samp(score), 4) as score_std
  from metrics where category is not null group by category""",
    "summary_metrics": f"""with {METRICS}
select '{RUN_DATE}' as execution_date, count(*) as total_records,
  round(avg(value), 4) as average_value, round(median(value), 4) as median_value,
  round(stddev_samp(value), 4) as std_value, round(avg(score), 4) as average_score,
  count(distinct category) as categories from metrics""",
    "describe": "\nunion all ".join(_description(c) for c in NUMBERS),
    "overall_metrics": f"""with {METRICS}
select count(*) as total_records, round(avg(value), 4) as average_value,
  max(value) as max_value, min(value) as min_value from metrics""",
    "histogram": f"""with {METRICS}, ends as (
  select min(value) as lo, max(value) as hi, (max(value) - min(value)) / 30 as step from metrics),
guessed as (
  select value, lo, step, least(floor((value - lo) * 30 / (hi - lo)), 29) as guess
  from metrics, ends),
counted as (
  select cast(guess - cast(value < lo + guess * step as integer)
    + cast(value >= lo + (guess + 1) * step and guess < 29 as integer) as integer) as bin,
    count(*) as n
  from guessed group by 1)
select cast(b as integer) as bin, round(lo + b * step, 4) as bin_start,
  round(lo + (b + 1) * step, 4) as bin_end, coalesce(n, 0) as "count"
  from range(30) as bins(b) cross join ends left join counted on bin = b""",
    "box_stats": f"""with {METRICS}
select category, min(value) as min, round(quantile_cont(value, 0.25), 4) as q25,
  round(quantile_cont(value, 0.5), 4) as median, round(quantile_cont(value, 0.75), 4) as q75,
  max(value) as max from metrics where category is not null group by category""",
    "value_counts": """select event_type, count(*) as "count" from events
  where event_type is not null group by event_type""",
    "ingest_metadata": f"""with {SPARSE}
select 'total_records' as kind, 'rows' as "key", count(*) as value from faulty
  union all select 'missing_values', 'amount', count(*) from faulty where amount is null
  union all select 'missing_values', 'category', count(*) from faulty where category is null
  union all select 'categories', category, count(*) from faulty
    where category is not null group by category""",
    "analysis_summary": _sales(
        f"""select '{RUN_DATE}' as analysis_date, '{REGION}' as region_filter,
  round(sum(total_amount), 2) as total_sales, cast(sum(quantity) as bigint) as total_quantity,
  count(distinct customer_id) as unique_customers, {AVG_AMOUNT} as avg_order_value,
  count(*) as records_processed from sales where region = '{REGION}'"""
    ),
    "regional_analysis": _sales(
        f"""select region, round(sum(total_amount), 2) as total_sales,
  {AVG_AMOUNT} as avg_sale, count(total_amount) as sale_count,
  cast(sum(quantity) as bigint) as total_quantity,
  count(distinct customer_id) as unique_customers
  from sales where region is not null group by region"""
    ),
    "product_analysis": _sales(
        f"""select product_id, round(sum(total_amount), 2) as total_sales,
  {AVG_AMOUNT} as avg_sale, cast(sum(quantity) as bigint) as total_quantity
  from sales where product_id is not null group by product_id"""
    ),
    "daily_trend": _sales(
        """select transaction_date, round(sum(total_amount), 2) as sales_amount
  from sales where transaction_date is not null group by transaction_date"""
    ),
    "dq_completeness": f"""with {DENSE}
select column_name, cast(sum(gone) as bigint) as missing_count, sum(gone) * cast(1 as double) / count(*) * 100
    as missing_percentage,
  sum(gone) * cast(1 as double) / count(*) * 100 <= {EVENT_RULES.max_missing * 100} as passed
  from (select unnest(['customer_id', 'transaction_date', 'amount', 'category',
      'payment_method']) as column_name,
    unnest([cast(customer_id is null as bigint), cast(transaction_date is null as bigint),
      cast(amount is null as bigint), cast(category is null as bigint),
      cast(payment_method is null as bigint)]) as gone from faulty) group by column_name""",
    "dq_uniqueness": f"""with {SPARSE}, copies as (
  select count(*) as n, (select count(*) from (select distinct * from faulty)) as d from faulty)
select n as total_records, d as unique_records, n - d as duplicate_count,
  cast(n - d as double) / n * 100 as duplicate_percentage,
  cast(n - d as double) / n * 100 <= {EVENT_RULES.max_duplicates * 100} as passed from copies""",
    "dq_validity": f"""with {SPARSE}
select 'amount' as column_name, count(*) as invalid_count, count(*) = 0 as passed
  from faulty where amount < 0 or amount > 10000
  union all select 'customer_id', count(*), count(*) = 0 from faulty where customer_id < 1""",
    "dq_consistency": f"""with {SPARSE}
select 'category' as column_name, count(*) as invalid_count, count(*) = 0 as passed
  from faulty where category is null or category not in {_in(EVENT_TYPES)}
  union all select 'payment_method', count(*), count(*) = 0
  from faulty where payment_method is null or payment_method not in {_in(PAYMENT_METHODS)}""",
    "dq_bad_values": f"""with {SPARSE}
select 'category' as column_name, category as value, count(*) as invalid_count
  from faulty where category is null or category not in {_in(EVENT_TYPES)} group by category
  union all select 'payment_method', payment_method, count(*) from faulty
  where payment_method is null or payment_method not in {_in(PAYMENT_METHODS)}
  group by payment_method""",
    "dq_overall": f"with {SPARSE}, {TESTS}\n{OVERALL}",
    "dq_overall_sound": f"with {SOUND}, {TESTS}\n{OVERALL}",
    "product_sales_ranked": _sales(
        """select product_id, round(sum(total_amount), 2) as total_amount
  from sales where product_id is not null group by product_id"""
    ),
    "regional_sales_ranked": _sales(
        """select region, round(sum(total_amount), 2) as total_amount
  from sales where region is not null group by region"""
    ),
    "last_30_days": _sales(
        """select transaction_date, round(sum(total_amount), 2) as sales_amount
  from sales where transaction_date is not null group by transaction_date
  order by transaction_date desc limit 30"""
    ),
    "top_region": _sales(
        """select region, round(sum(total_amount), 2) as total_revenue from sales group by region
  order by total_revenue desc, region limit 1"""
    ),
    "union_all": """select c_name as name, c_acctbal as balance from customer
  union all select s_name, s_acctbal from supplier""",
    "dedupe": f"with {DENSE}\nselect distinct * from faulty",
}

# Reports that are written and read back.
ORACLE |= {
    "json_scan": ORACLE["region_summary"],
    "csv_scan": ORACLE["category_summary"],
    "json_customers": ORACLE["customer_totals"],
    "written_parquet": ORACLE["category_analysis"],
    "written_runs": "\nunion all\n".join(
        f"select *, '{day}' as processing_date from ({ORACLE['region_sales']})"
        for day in (RUN_DATE, SLICE_DATE)
    ),
}
