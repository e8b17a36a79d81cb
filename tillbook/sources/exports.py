"""Full-table dumps and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillbook.plans.worktables import CODEC
from tillbook.sources.ranges import read_csv_ranges

FORMATS = ("parquet", "csv")

#: Quotes inside a cell are doubled and cells keep outer blanks and line breaks, as
#: spreadsheets write them; NULL has a text of its own, so that a blank cell survives.
CSV_CELLS = {
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def export_table(
    df: DataFrame, path: str, fmt: str = "parquet", month_of: str | None = None
) -> None:
    """Write every row and column of ``df`` to a new directory, one file per task.

    ``month_of`` names a date column; rows are then laid out in a folder per month of it,
    ``month=YYYY-MM-01``, so that readers of a few months read only those.
    """
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {FORMATS}, not {fmt!r}")
    if month_of:
        df = df.withColumn("month", F.trunc(month_of, "MM"))
    writer = df.write.mode("errorifexists").format(fmt)
    if month_of:
        writer = writer.partitionBy("month")
    if fmt == "csv":
        writer = writer.options(header=True, emptyValue='""', **CSV_CELLS)
    else:
        writer = writer.options(**CODEC)
    writer.save(path)


def read_export(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", ranges: bool = False
) -> DataFrame:
    """Read what ``export_table`` wrote, as it was.

    A CSV file is read by one task, or with ``ranges`` by as many as it has splits.
    """
    if fmt == "csv" and ranges:
        return read_csv_ranges(spark, path, schema, {"emptyValue": "", **CSV_CELLS})
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, emptyValue="", **CSV_CELLS)
    return reader.load(path)
