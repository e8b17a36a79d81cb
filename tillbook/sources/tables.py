"""Readers for the stored tables and for intake files."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillbook.sources.exports import CSV_CELLS
from tillbook.sources.schemas import RAW_PRODUCTS, TABLES


@dataclass(frozen=True)
class Tables:
    products: DataFrame
    categories: DataFrame
    producers: DataFrame
    sales: DataFrame
    returns: DataFrame
    special_days: DataFrame


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan one stored table with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{directory}/{name}")


def load_tables(spark: SparkSession, directory: str) -> Tables:
    """Scan the six stored tables under ``directory``."""
    return Tables(**{name: load_table(spark, directory, name) for name in TABLES})


def read_raw_products(spark: SparkSession, path: str) -> DataFrame:
    """CSV intake files with a header, every field as text.

    Each file is read by its own header, so files of one folder may order their columns
    differently; columns nobody asked for are ignored, and a column that no file has is
    left for intake to report. A file that lacks a column others have gives NULL there.
    Cells may hold quotes (doubled), commas, line breaks and outer blanks. Because of
    line breaks a file is read by one task; files are read side by side.
    """
    layouts: dict[str, list[str]] = {}
    for row in _first_lines(spark, path).toLocalIterator():  # one row for each file
        layouts.setdefault(row["header"].removeprefix("\ufeff").strip(), []).append(row["file"])
    parts = []
    for header, files in sorted(layouts.items()):
        names = next(csv.reader([header]))
        schema = StructType([StructField(name, StringType()) for name in names])
        wanted = [f for f in RAW_PRODUCTS.fieldNames() if f in names]
        reader = spark.read.schema(schema).options(header=True, multiLine=True, **CSV_CELLS)
        parts.append(reader.csv(files).select(*wanted))
    if not parts:
        raise ValueError(f"no file with a header under {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the first line of every file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
        F.monotonically_increasing_id().alias("place"),
    )
    return (
        lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "place").alias("header"))
    )
