"""File readers with fixed or inferred schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerline import schemas
from ledgerline.functions.columns import named
from ledgerline.session import materialize

CORRUPT = "_corrupt_record"


# Other names that a column may have in a file.
OTHER_NAMES = {"product_category": "category"}


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header line, whose names say which column is which.

    With a schema its columns are found by name, in any order and among others; a value of
    another type becomes null, a missing column raises. Without one the types are inferred,
    which reads the data twice and takes ids such as T1 for times.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    text = reader.csv(path)
    columns = []
    for field in schema.fields:
        names = [field.name, OTHER_NAMES.get(field.name)]
        found = next((n for n in names if n in text.columns), None)
        if found is None:
            raise ValueError(f"{path} has no column {field.name}; it has {text.columns}")
        columns.append(named(found).try_cast(field.dataType).alias(field.name))
    return text.select(*columns)


def read_json(
    spark: SparkSession, path: str, schema: StructType, quarantine: bool = False
) -> DataFrame:
    """JSON lines under a fixed schema. An unparsable line becomes an all-null row; with
    quarantine its text is kept in `_corrupt_record` (see split_corrupt)."""
    if quarantine:
        schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the raw text of the lines that did not parse or hold a value of the
    wrong type. The parsed rows are written out first: a later query that reads fewer
    columns would otherwise parse only those and miss errors in the others."""
    parsed = materialize(df)
    bad = F.col(CORRUPT).isNotNull()
    return parsed.filter(~bad).drop(CORRUPT), parsed.filter(bad).select(CORRUPT)


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Raise when there is nothing to process; reads one row, not all."""
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    return require_rows(read_json(spark, path, schemas.SALES), path)


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.SALES)


def read_dated_csv(
    spark: SparkSession, path: str, schema: StructType, date_column: str
) -> DataFrame:
    """CSV whose date column is text; a value that is no date becomes null."""
    text = StructType(
        [
            StructField(f.name, StringType()) if f.name == date_column else f
            for f in schema.fields
        ]
    )
    return read_csv(spark, path, text).withColumn(
        date_column, F.try_to_date(F.col(date_column))
    )


def run_slice(df: DataFrame, run_date: str, column: str = "ds") -> DataFrame:
    """One run date. On a date-partitioned layout only that folder is read."""
    return df.filter(F.col(column) == F.lit(run_date))


def run_file(folder: str, run_date: str, extension: str = "json", stem: str = "sales") -> str:
    """Path of the file that one run of the file-per-run layout produced."""
    return f"{folder.rstrip('/')}/{stem}_{run_date}.{extension}"


def read_or_create(
    spark: SparkSession, path: str, schema: StructType, example: DataFrame
) -> DataFrame:
    """Reuse the CSV at the path, or write the example there first. A folder counts only
    if the write that made it was completed; what a broken one left is replaced."""
    if not _complete(spark, path):
        example.write.mode("overwrite").option("header", True).csv(path)
    return read_csv(spark, path, schema)


def _complete(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return False
    return store.getFileStatus(place).isFile() or store.exists(hadoop.Path(place, "_SUCCESS"))


def read_star_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.STAR[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")
