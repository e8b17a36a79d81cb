"""What several operators share: tables, row identity, positions in a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillbook.plans.worktables import materialize

#: Rows that one task ranks; a group with more is ranked in buckets.
ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def located(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` and a column that tells its rows apart: the file and the row's place in it.

    A frame that no file scan stands behind is written to the work folder first.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["row_index"])
    except Exception:  # noqa: BLE001  not a plain scan: it has no such column
        docs = materialize(docs, "located")
        meta = docs.metadataColumn("_metadata")
    return docs, F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def with_positions(
    df: DataFrame,
    group: str,
    order: list[str],
    out: str,
    sizes: DataFrame | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Number the rows of each ``group`` from 0 without gaps, as column ``out``.

    A group of any size is dealt over hash buckets of ``order`` (which must tell rows
    apart, or equal rows get their numbers in any order); rows are ranked within a bucket
    and shifted by the sizes of the buckets before. Only bucket sizes, a few numbers for
    a million rows, are ordered by group. ``sizes`` may be a narrower frame with the same
    ``group`` and ``order`` columns and rows, for cheaper counting.
    """
    sizes = df if sizes is None else sizes
    largest = sizes.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-largest // rows_per_bucket))
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in order])
    bits = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    bucket = F.pmod(bits, F.lit(buckets)).alias("_bucket")
    before = (
        Window.partitionBy(group)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        sizes.select(group, bucket)
        .groupBy(group, "_bucket")
        .count()
        .select(group, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    rank = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))
    ranked = df.withColumn("_bucket", bucket).withColumn("_nth", rank)
    return (
        ranked.join(starts, [group, "_bucket"])
        .withColumn(out, (F.col("_start") + F.col("_nth") - 1).cast("long"))
        .drop("_bucket", "_start", "_nth")
    )


def numbered(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    out: str,
    upto: int | None = None,
    rows_per_part: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Number the rows of each ``group`` from 1 in ``order``; ``group`` may be empty.

    Rows are range-partitioned by group and order and written, so that a group of any size
    lies in consecutive parts of bounded size. Rows are ranked within a part, and what
    earlier parts hold of a group is added where it goes on: at most once a part, which
    bounds the table that is broadcast. Beyond ``upto`` the number is null, and parts that
    begin beyond it are not sorted. Groups must not be null.
    """
    spark = df.sparkSession
    df = materialize(df, "unnumbered")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-df.count() // rows_per_part))
    placed = materialize(
        df.repartitionByRange(parts, *[F.col(g) for g in group], *order).withColumn(
            "_part", F.spark_partition_id()
        ),
        "parts",
    )
    before = (
        Window.partitionBy(*group)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        placed.groupBy(*group, "_part")
        .count()
        .withColumn("_start", F.sum("count").over(before))
        .filter("_start is not null")
        .drop("count")
    )
    moved = placed.join(F.broadcast(starts), [*group, "_part"], "left").withColumn(
        "_start", F.coalesce("_start", F.lit(0))
    )
    rank = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    if upto is None:
        return moved.withColumn(out, (F.col("_start") + rank).cast("long")).drop("_part", "_start")
    number = (F.col("_start") + rank).cast("long")
    early = moved.filter(F.col("_start") < upto).withColumn("_nth", number)
    early = early.withColumn(out, F.when(F.col("_nth") <= upto, F.col("_nth"))).drop("_nth")
    late = moved.filter(F.col("_start") >= upto).withColumn(out, F.lit(None).cast("long"))
    return early.unionByName(late).drop("_part", "_start")


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): high or low, as the quality label is 1 or 0; other rows are left out."""
    domain = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).filter("domain is not null")


def quality_and_toxicity_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, else high or low; rows without a label 0 or 1 are left out."""
    toxic = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "")
    domain = F.when(toxic == "toxic", toxic).when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", F.when(toxic.isNotNull(), domain).alias("domain")).filter(
        "domain is not null"
    )
