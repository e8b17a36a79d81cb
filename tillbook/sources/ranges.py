"""CSV files with line breaks in cells, read in byte ranges side by side.

A line break ends a record only outside quotes, and whether a range begins inside a cell
depends on all quotes before it. A first pass counts quotes per range; the sums before each
range tell which begin inside. The second pass puts lines together to records within each
range, and only the pieces of records that cross a border are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillbook.plans.worktables import materialize

#: Ranges that begin inside a cell are told to all tasks, up to so many.
MOST_OPEN = 100_000
#: What a piece is: a record, or the end, the middle or the beginning of one.
RECORD, END, MIDDLE, BEGINNING = range(4)


def read_csv_ranges(
    spark: SparkSession, path: str, schema: StructType, options: dict, most_open: int = MOST_OPEN
) -> DataFrame:
    """The rows of CSV files with a header, as Spark's reader gives them with ``multiLine``.

    Files may be split anywhere (``spark.sql.files.maxPartitionBytes``). Quotes may stand in
    quoted cells alone, doubled, and lines end in ``\\n`` or ``\\r\\n``: files of
    ``export_table`` are like that. If more than ``most_open`` ranges begin inside a cell,
    each file is read by one task.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = materialize(
        lines.groupBy("file", "start")
        .agg(F.sum(quotes).alias("quotes"))
        .withColumn("before", F.sum("quotes").over(before))
        .filter("before % 2 = 1")
        .select("file", "start"),
        "open-ranges",
    )
    if opened.count() > most_open:
        return spark.read.schema(schema).options(header=True, multiLine=True, **options).csv(path)
    inside = spark.sparkContext.broadcast({(r["file"], r["start"]) for r in opened.collect()})
    pieces = materialize(
        lines.mapInArrow(_pieces(inside), "file string, start long, first boolean, kind int, text string"),
        "pieces",
    )
    whole = pieces.filter(F.col("kind") == RECORD).select("first", "text")
    across = materialize(_across(pieces.filter(F.col("kind") != RECORD)), "across")
    records = whole.unionByName(across)
    text = F.regexp_replace("text", "\r$", "")
    texts = records.filter("not first").select(text.alias("text")).filter("text <> ''")
    cells = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
    row = F.from_csv("text", schema.toDDL(), cells | {"multiLine": "true"})
    return texts.select(row.alias("row")).select("row.*")


def _across(parts: DataFrame) -> DataFrame:
    """(first, text): the records whose pieces lie in several ranges."""
    before = Window.partitionBy("file").orderBy("start", "kind")
    begun = F.last(F.when(F.col("kind") == BEGINNING, F.col("start")), ignorenulls=True)
    pieces = F.sort_array(F.collect_list(F.struct("start", "text")))
    return (
        parts.withColumn("begun", begun.over(before))
        .groupBy("file", "begun")
        .agg(F.max("first").alias("first"), pieces.alias("pieces"))
        .select("first", F.array_join(F.col("pieces.text"), "\n").alias("text"))
    )


def _pieces(inside):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of a range arrive in order, maybe over several batches; ranges one after another."""
        opened = inside.value
        key, is_open, entered, held, first = None, False, False, [], False

        def unfinished() -> tuple:
            return (*key, first, MIDDLE if entered else BEGINNING, "\n".join(held))

        for batch in batches:
            files, starts, values = batch.columns
            odd = pc.count_substring(values, '"').to_numpy().astype(np.int64) % 2
            out = []
            one = len(files.unique()) == len(starts.unique()) == 1
            if one and (files[0].as_py(), starts[0].as_py()) == key and not (is_open or first or odd.any()):
                n = batch.num_rows
                flags = pa.array(np.zeros(n, bool)), pa.array(np.full(n, RECORD, np.int32))
                yield pa.RecordBatch.from_arrays([files, starts, *flags, values], names=_NAMES)
                continue
            rows = zip(files.to_pylist(), starts.to_pylist(), values.to_pylist(), odd, strict=True)
            for file, start, value, turns in rows:
                if (file, start) != key:
                    if held:
                        out.append(unfinished())
                    key, held = (file, start), []
                    is_open = entered = key in opened
                    first = start == 0
                held.append(value)
                is_open ^= bool(turns)
                if not is_open:
                    out.append((*key, first, END if entered else RECORD, "\n".join(held)))
                    held, first, entered = [], False, False
            yield _batch(out)
        if held:
            yield _batch([unfinished()])

    return run


_NAMES = ["file", "start", "first", "kind", "text"]
_TYPES = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES
    )
