"""Retail tables derived from the TPC-H-like test tables (FIXTURES.md, section 2).

A table is derived when first asked for, over the whole of its input, written to the
work folder and from then on scanned like any stored retail table.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.plans.worktables import new_path
from tillbook.sources import export_table, load_table, read_raw_products
from tillbook.sources.schemas import RETURN_REQUESTS, SALE_REQUESTS, TABLES

AS_OF = dt.date(2001, 7, 31)

# Suppliers whose places are broadcast at most; more of them are joined by shuffle.
BROADCAST_SUPPLIERS = 1_000_000

_STAGED: dict[tuple[str, str], RetailData] = {}


def retail_data(spark: SparkSession, source: str) -> RetailData:
    """The retail tables of one source directory, shared within an application."""
    key = (spark.sparkContext.applicationId, source)
    if key not in _STAGED:
        _STAGED[key] = RetailData(spark, source)
    return _STAGED[key]


class RetailData:
    def __init__(self, spark: SparkSession, source: str) -> None:
        self.spark = spark
        self.source = source
        self.folder = new_path(spark, "retail")

    def read(self, name: str) -> DataFrame:
        """One of the given tables."""
        return self.spark.read.parquet(f"{self.source}/{name}.parquet")

    def _stored(self, name: str, df: DataFrame) -> DataFrame:
        columns = df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields])
        export_table(columns, f"{self.folder}/{name}")
        return load_table(self.spark, self.folder, name)

    def _work(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        export_table(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def categories(self) -> DataFrame:
        return self._stored(
            "categories",
            self.read("part")
            .groupBy(F.col("p_type").alias("category_name"))
            .agg(F.min("p_partkey").alias("category_id")),
        )

    @cached_property
    def producers(self) -> DataFrame:
        return self._stored(
            "producers",
            self.read("part")
            .groupBy(F.col("p_brand").alias("producer_name"))
            .agg(F.min("p_partkey").alias("producer_id")),
        )

    def _parts(self) -> DataFrame:
        """Every part as a product row, before any field is blanked."""
        price = F.col("p_retailprice").cast("decimal(18,2)")
        return (
            self.read("part")
            .join(self.categories, F.col("p_type") == F.col("category_name"))
            .join(self.producers, F.col("p_brand") == F.col("producer_name"))
            .select(
                F.col("p_partkey").alias("product_id"),
                F.col("p_name").alias("product_name"),
                F.when(F.col("p_size") != 13, F.col("category_id")).alias("category_id"),
                (price * F.lit(0.7).cast("decimal(2,1)")).cast("decimal(18,2)").alias("buy_price"),
                price.alias("sell_price"),
                F.split_part("p_name", F.lit(" "), F.lit(1)).alias("color"),
                F.when(F.col("p_size") == 27, -1)
                .otherwise(F.col("producer_id"))
                .alias("producer_id"),
                F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
                F.col("p_type").alias("description"),
                "p_size",
                "p_brand",
                F.date_sub(F.lit(AS_OF), (F.col("p_partkey") * 13 % 121).cast("int")).alias("day"),
            )
        )

    @cached_property
    def products(self) -> DataFrame:
        size = F.col("p_size").cast("bigint")
        stock = F.when(size <= 4, 0).when(size != 31, size * 400)
        return self._stored(
            "products",
            self._parts()
            .withColumn("stock_qty", stock)
            .withColumn("sold_qty", F.when(size != 33, size + 500))
            .withColumn("complaint_qty", F.lit(0))
            .withColumn("ordered_on", F.when(size != 43, F.col("day"))),
        )

    @cached_property
    def sales_lines(self) -> DataFrame:
        """Every line item as a sale, with the columns the request tables need.

        The places of suppliers are put together first, so that lines meet one narrow table
        and are not shuffled while that is small. Stores by month lay rows out themselves.
        """
        line = F.col("l_linenumber")
        whole = F.col("l_quantity").cast("bigint")
        day = F.col("l_shipdate").cast("date")
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        key = F.concat_ws(
            "|",
            *[
                c.cast("string")
                for c in (
                    F.col("l_orderkey"),
                    line,
                    F.col("l_partkey"),
                    F.col("l_suppkey"),
                    whole,
                    cents,
                    day,
                )
            ],
        )
        places = (
            self.read("supplier")
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", "r_name")
        )
        few = self.read("supplier").count() <= BROADCAST_SUPPLIERS
        lines = (
            self.read("lineitem")
            .join(F.broadcast(places) if few else places, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.md5(key).alias("sale_id"),
                F.when(~((whole == 3) & (line == 3)), day).alias("sold_on"),
                F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
                F.when((whole == 50) & (line >= 6), -1 - F.col("l_partkey"))
                .when(F.col("l_partkey") % 101 == 0, F.col("l_partkey") + 1)
                .otherwise(F.col("l_partkey"))
                .alias("product_id"),
                F.when(~((whole == 1) & (line == 1)), F.col("r_name")).alias("place"),
                F.when(~((whole == 2) & (line == 2)), whole).alias("qty"),
                day.alias("ship_day"),
                whole.alias("units"),
                line.alias("line"),
                F.col("l_returnflag").alias("return_flag"),
                F.col("l_linestatus").alias("status"),
                F.col("l_tax").alias("tax"),
            )
        )
        return self._work("sales_lines", lines)

    @cached_property
    def sales(self) -> DataFrame:
        return self.sales_lines.select(*TABLES["sales"].fieldNames())

    @cached_property
    def returns(self) -> DataFrame:
        return self._stored(
            "returns",
            self.sales_lines.filter(F.col("return_flag") == "R").select(
                F.md5(F.concat(F.lit("r"), F.col("sale_id"))).alias("return_id"),
                "product_id",
                F.when(F.col("line") != 7, F.col("tax") >= 0.04).alias("defective"),
                F.when(F.col("line") == 1, 'said "no",\nand left')
                .when(F.col("line") == 2, "  blanks around ")
                .when(F.col("line") == 3, "")
                .when(F.col("line") != 4, "returned")
                .alias("description"),
            ),
        )

    @cached_property
    def special_days(self) -> DataFrame:
        start = F.col("o_orderdate").cast("date")
        length = F.substring("o_orderpriority", 1, 1).cast("int") * 3
        return self._stored(
            "special_days",
            self.read("orders").select(
                F.col("o_orderkey").alias("id"),
                F.when(F.col("o_orderpriority") == "1-URGENT", "Communion")
                .otherwise(F.concat(F.lit("Promotion "), F.col("o_orderpriority")))
                .alias("name"),
                start.alias("starts_on"),
                F.date_add(start, length).alias("ends_on"),
            ),
        )

    @property
    def places(self) -> DataFrame:
        """The caller's list of places: the regions, one unknown to sales."""
        regions = self.read("region").select(
            F.col("r_name").alias("place"),
            (F.col("r_regionkey") * 10.0).alias("lat"),
            (F.col("r_regionkey") * 20.0).alias("lng"),
        )
        unknown = self.spark.range(1).select(
            F.lit("OCEANIA").alias("place"),
            F.lit(-22.0).cast("double").alias("lat"),
            F.lit(140.0).cast("double").alias("lng"),
        )
        return regions.unionByName(unknown)

    @property
    def selling_places(self) -> DataFrame:
        """The places that sales know."""
        return self.places.filter(F.col("place") != "OCEANIA")

    @property
    def mapped_places(self) -> DataFrame:
        """The places on the map: all of them but one region."""
        return self.places.filter(F.col("place") != "MIDDLE EAST")

    @cached_property
    def raw_products(self) -> DataFrame:
        """Every part as a row of an intake file, some with faults; stored as CSV.

        Odd and even parts lie in files of different column order, in one folder.
        """
        size = F.col("p_size")
        rows = self.read("part").select(
            F.when(size == 29, None)
            .when(size == 23, "")
            .otherwise(F.col("p_name"))
            .alias("product_name"),
            F.when(size == 17, "UNKNOWN").otherwise(F.col("p_type")).alias("category_name"),
            F.when(size == 19, "-5")
            .when(size == 20, "n/a")
            .when(F.col("p_brand") == "Brand#3", "10.5")
            .otherwise("700")
            .alias("buy_price"),
            F.lit("900").alias("sell_price"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("color"),
            F.when(size == 14, "NOBODY").otherwise(F.col("p_brand")).alias("producer_name"),
            F.concat(F.lit("NEW-"), F.col("p_partkey").cast("string")).alias("sku"),
            F.concat(F.lit('  a "new" part,\n'), F.col("p_type"), F.lit(" ")).alias("description"),
            F.when(size == 11, "-1")
            .when(size == 12, "1.5")
            .otherwise(size.cast("string"))
            .alias("stock_qty"),
            F.when(size <= 10, (size * 10 + 36526).cast("string"))
            .when(size <= 20, "2001-05-06")
            .when(size <= 30, "1999-12-31")
            .when(size == 35, "not a date")
            .when(size == 36, None)
            .otherwise("2001-05-06 10:00:00")
            .alias("ordered_on"),
            F.lit("x").alias("a_column_nobody_reads"),
            (F.col("p_partkey") % 2 == 0).alias("even"),
        )
        path = f"{self.folder}/raw_products"
        export_table(rows.filter("even").drop("even"), path, "csv")
        other = f"{self.folder}/raw_products_other"
        turned = [c for c in reversed(rows.columns) if c != "even"]
        export_table(rows.filter("not even").select(*turned), other, "csv")
        return read_raw_products(self.spark, f"{self.folder}/raw_products*")

    @property
    def ledger_products(self) -> DataFrame:
        """Products with a tenth of the stock, so that sale requests run short."""
        return self.products.withColumn("stock_qty", F.expr("stock_qty div 10"))

    @cached_property
    def sale_requests(self) -> DataFrame:
        """Every sale line as a request, some of them twice; served by day, then id."""
        units, line = F.col("units"), F.col("line")
        requests = self.sales_lines.select(
            F.col("sale_id").alias("request_id"),
            "product_id",
            F.unix_date("ship_day").cast("bigint").alias("seq"),
            F.when((units == 4) & (line == 4), -1).otherwise(F.col("qty")).alias("qty"),
            "place",
            "sold_on",
        )
        repeats = requests.filter((F.col("qty") == 5) & (F.col("seq") % 5 == 0)).withColumn(
            "seq", F.col("seq") + 1
        )
        return requests.unionByName(repeats).select(*SALE_REQUESTS.fieldNames())

    @cached_property
    def return_requests(self) -> DataFrame:
        """A request for every returned line, some of them twice, and one more for open lines."""
        units, line = F.col("units"), F.col("line")
        returned = self.sales_lines.filter(F.col("return_flag") == "R")
        first = returned.select(
            F.md5(F.concat(F.col("sale_id"), F.lit("1"))).alias("request_id"),
            F.when((units == 6) & (line == 6), F.concat(F.lit("x"), F.col("sale_id")))
            .otherwise(F.col("sale_id"))
            .alias("sale_id"),
            F.lit(1).cast("bigint").alias("seq"),
            F.when((units == 7) & (line == 7), None)
            .when(line == 1, units + 1)
            .when(line == 2, units)
            .otherwise((line + 1).cast("bigint"))
            .alias("qty"),
            (F.col("tax") >= 0.04).alias("defective"),
            F.when(units == 8, "").otherwise("returned").alias("description"),
        )
        second = returned.filter(F.col("status") == "O").select(
            F.md5(F.concat(F.col("sale_id"), F.lit("2"))).alias("request_id"),
            "sale_id",
            F.lit(2).cast("bigint").alias("seq"),
            (line + 1).cast("bigint").alias("qty"),
            F.when(units != 9, F.col("tax") >= 0.02).alias("defective"),
            F.lit("again").alias("description"),
        )
        repeats = first.filter(F.col("qty") == 5).withColumn("seq", F.lit(3).cast("bigint"))
        requests = first.unionByName(second).unionByName(repeats)
        return requests.select(*RETURN_REQUESTS.fieldNames())

    @cached_property
    def product_changes(self) -> DataFrame:
        """A change for every part, some faulty; a later second one for one brand, and one
        of the same ``seq`` for another."""
        size = F.col("p_size")
        first = self._parts().select(
            F.when(size == 50, -1 - F.col("product_id"))
            .otherwise(F.col("product_id"))
            .alias("product_id"),
            F.when(size != 45, F.lit(1).cast("bigint")).alias("seq"),
            F.when(size == 41, "")
            .otherwise(F.concat(F.col("product_name"), F.lit(" II")))
            .alias("product_name"),
            "category_id",
            "buy_price",
            (F.col("sell_price") + 1).cast("decimal(18,2)").alias("sell_price"),
            "color",
            "producer_id",
            F.when(size != 42, F.col("sku")).alias("sku"),
            "description",
            size.cast("bigint").alias("stock_qty"),
            F.when(size != 44, F.col("day")).alias("ordered_on"),
            "p_brand",
        )
        second = (
            first.filter(F.col("p_brand") == "Brand#1")
            .withColumn("seq", F.lit(2).cast("bigint"))
            .withColumn("color", F.lit("repainted"))
        )
        tied = first.filter(F.col("p_brand") == "Brand#2").withColumn("color", F.lit("undecided"))
        changes = first.unionByName(second).unionByName(tied)
        return self._work("product_changes", changes.drop("p_brand"))

    @cached_property
    def new_products(self) -> DataFrame:
        """Every part as a product to add, some without a required field."""
        size = F.col("p_size")
        rows = self._parts().select(
            F.when(size == 41, "").otherwise(F.col("product_name")).alias("product_name"),
            "category_id",
            "buy_price",
            "sell_price",
            "color",
            "producer_id",
            F.when(size == 42, "")
            .otherwise(F.concat(F.lit("ADD-"), F.col("sku")))
            .alias("sku"),
            "description",
            size.cast("bigint").alias("stock_qty"),
            F.col("day").alias("ordered_on"),
        )
        return self._work("new_products", rows)

    @property
    def product_pairs(self) -> DataFrame:
        """Every product paired with the next one."""
        return self.products.select(
            F.col("product_id").alias("pair_id"),
            F.col("product_id").alias("product_1"),
            (F.col("product_id") + 1).alias("product_2"),
        )

    @property
    def text_date_products(self) -> DataFrame:
        """Products with the order date as text: seconds before 1970 and far off, ISO text."""
        number, way = F.col("product_id"), F.col("product_id") % 4
        return self.products.withColumn(
            "ordered_on",
            F.when(way == 0, (-number * 86400 + 1).cast("string"))
            .when(way == 1, (number + 95617584000).cast("string"))
            .when(way == 2, (number * 1000).cast("string"))
            .otherwise("2001/5/6"),
        )

    @property
    def sold_out_ids(self) -> DataFrame:
        """Ids to delete: products with nothing in stock, each twice."""
        ids = self.products.filter(F.col("stock_qty") == 0).select("product_id")
        return ids.unionAll(ids)
