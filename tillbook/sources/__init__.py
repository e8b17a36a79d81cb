"""Table schemas, readers and writers."""

from tillbook.sources.exports import export_table, read_export
from tillbook.sources.ranges import read_csv_ranges
from tillbook.sources.store import MonthStore
from tillbook.sources.tables import Tables, load_table, load_tables, read_raw_products

__all__ = [
    "MonthStore",
    "Tables",
    "export_table",
    "load_table",
    "load_tables",
    "read_csv_ranges",
    "read_export",
    "read_raw_products",
]
