"""Documents from files, and results to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_documents(spark: SparkSession, path: str, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """``doc_id``, ``raw`` of a Parquet table; only the two columns are read."""
    rows = spark.read.parquet(path)
    raw = F.col(column) if rows.schema[column].dataType.simpleString() == "binary" else F.encode(column, "UTF-8")
    return rows.select(F.col(id_column).alias("doc_id"), raw.alias("raw"))


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of any bytes; the id is the file's path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.col("content").alias("raw"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """A document for each line; the id is its file, and the line feed after it is told apart."""
    rows = spark.read.text(path).select(F.input_file_name().alias("doc_id"), F.encode("value", "UTF-8").alias("raw"))
    return rows.withColumn("newline", F.lit(True))


def json_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", column: str = "text") -> DataFrame:
    return spark.read.schema(schema).json(path).select("doc_id", F.encode(column, "UTF-8").alias("raw"))


def decoded(raw: Column) -> Column:
    """Text of bytes; invalid parts become replacement characters."""
    return F.make_valid_utf8(raw.cast("string"))


def save_units(units: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Units as Parquet, for others to read without this package."""
    units.write.mode(mode).parquet(path)


def units_json(units: DataFrame) -> DataFrame:
    """``doc_id`` and its units as one JSON text, in order."""
    fields = [c for c in units.columns if c != "doc_id"]
    listed = F.array_sort(F.collect_list(F.struct("unit_idx", *[c for c in fields if c != "unit_idx"])))
    return units.groupBy("doc_id").agg(F.to_json(listed).alias("units"))
