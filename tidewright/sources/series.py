"""Reading series and documents: everything arrives as text and is coerced by an explicit policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a number may look like; try_cast alone would also take '1d' or 'infinity'.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """The finite number that a text holds, else null; blanks around it do not matter."""
    value = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(value) != float("inf"), value)


def finite(value: Column) -> Column:
    """The value where it is a finite number, else null."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)


def read_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """file, row, and the named columns as text. A column that the header lacks is an error.

    row numbers the records of each file in their order; a file is read by one task at a time so
    that the order is the file's.
    """
    reader = spark.read.option("header", header).option("enforceSchema", False).option("mode", "PERMISSIVE").option("inferSchema", False)
    raw = reader.csv(path)
    if not header:
        raw = raw.toDF(*columns[: len(raw.columns)], *raw.columns[len(columns) :])
    lacking = [c for c in columns if c not in raw.columns]
    if lacking:
        raise ValueError(f"no column {', '.join(lacking)} among {', '.join(raw.columns)}")
    named = raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("file"), F.monotonically_increasing_id().alias("at"), *columns)
    return named.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).drop("at")


def series_from_csv(spark: SparkSession, path: str, column: str, policy: str = "drop", header: bool = True) -> DataFrame:
    """series_id (the file's stem), t, value of one column of each file under path."""
    rows = read_csv(spark, path, [column], header)
    return clean(rows.select(F.col("file").alias("series_id"), F.col("row").cast("long").alias("t"), number(F.col(column)).alias("value")), policy)


def pair_from_csv(spark: SparkSession, path: str, y: str, u: str | None = None) -> DataFrame:
    """series_id, t, y, u of two aligned columns; cells that are no numbers are NaN."""
    rows = read_csv(spark, path, [y, *([u] if u else [])])
    cell = lambda c: F.coalesce(number(F.col(c)), F.lit(float("nan")))
    return rows.select(F.col("file").alias("series_id"), F.col("row").cast("long").alias("t"), cell(y).alias("y"), *([cell(u).alias("u")] if u else []))


def clean(series: DataFrame, policy: str = "drop", value: str = "value") -> DataFrame:
    """series_id, t, value by one of three policies for what is no finite number.

    drop: leaves the row out and numbers the others anew from 0; zero: puts 0 in its place; keep:
    leaves it null. The modules of the analytics differ in this, so nothing is unified silently.
    """
    own = series.select("series_id", F.col("t").cast("long").alias("t"), finite(F.col(value).cast("double")).alias("value"))
    if policy == "keep":
        return own
    if policy == "zero":
        return own.withColumn("value", F.coalesce("value", F.lit(0.0)))
    if policy != "drop":
        raise ValueError(f"policy {policy}: one of drop, zero, keep")
    order = Window.partitionBy("series_id").orderBy("t")
    return own.where("value is not null").withColumn("t", F.row_number().over(order).cast("long") - 1)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents of a given schema; unknown keys are ignored, a malformed document is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Replaces a folder of JSON documents; the commit protocol makes it all or nothing."""
    df.write.mode("overwrite").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """source_ref, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_ref"), F.col("value").alias("text"))
