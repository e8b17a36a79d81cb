"""Exact deduplication as a stateful stream.

Fingerprints of the rows are streamed into a keyed aggregation whose state lives on disk
(RocksDB) and never expires: digest -> stable identifier, content locator (file and row)
and number of rows. Rows of a digest that has several are hits; their full bytes are
compared with those of the row that stays. Only DataFrame operations run on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm.common import located, text_of
from tillbook.plans.worktables import materialize, new_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one digest that are compared with one copy of the text that stays.
ROWS_PER_COPY = 500


def first_row() -> Column:
    """Orders rows by doc_id, null last, then by place."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")


def normalised(text: Column) -> Column:
    """White-space runs become one space; single spaces need no replacing."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keepers(stream: DataFrame, folder: str) -> None:
    """Run a stream of (doc_id, at, digest) through the keyed state to its present end.

    Run again with the same folder after new rows arrived, it goes on from the kept
    state. Each batch writes only the keys it touched, for ``latest`` to read.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/touched/batch={number}")

    (
        stream.groupBy("digest")
        .agg(F.min(first_row()).alias("keep"), F.count("*").alias("n"))
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Per digest: ``keep`` (doc_id, at) of the row that stays and ``n``, the number of rows.

    ``keep`` only falls and ``n`` only grows, so the latest values are their min and max.
    """
    touched = spark.read.parquet(f"{folder}/touched")
    return touched.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("n").alias("n"))


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the disk-backed state store."""
    own = spark.newSession()
    for key, value in (
        ("spark.sql.streaming.stateStore.providerClass", STATE_STORE),
        # thousands of small stores: no space set aside for each, only changes uploaded
        ("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false"),
        ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"),
        ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")),
        ("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone")),
    ):
        own.conf.set(key, value)
    return own


def deduplicate(docs: DataFrame, digest=sha256) -> DataFrame:
    """Per row of ``docs``: at (file, row), doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical after white-space runs become one space; null counts
    as empty. Of equal texts the row with the smallest doc_id stays (a null doc_id comes
    last); rows that share it go by file and row, so a repeated row stays once. Rows of
    one digest whose bytes differ from the text that stays are grouped by full text
    instead. An empty table gives no rows. Columns other than doc_id and text are not
    read.
    """
    spark = docs.sparkSession
    docs, at = located(docs)
    text = normalised(text_of(docs))
    prints = materialize(
        docs.select("doc_id", at.alias("at"), digest(text).alias("digest")), "prints"
    )
    if prints.isEmpty():
        return prints.select(
            "at", "doc_id", F.col("doc_id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest",
        )
    own = stream_session(spark)
    folder = new_path(spark, "dedup")
    keepers(own.readStream.schema(prints.schema).parquet(_folder_of(prints)), folder)
    # written, so that Spark may split the rows of a hot digest in the join
    state = materialize(latest(spark, folder), "kept")
    rows = materialize(prints.join(state, "digest"), "rows")
    differ = materialize(_differing(docs, at, text, rows), "differ")
    if not differ.isEmpty():
        rows = _regrouped(rows, differ)
    return rows.select(
        "at",
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("at") == F.col("keep.at")).alias("kept"),
        "digest",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``deduplicate`` keeps, with all their columns."""
    docs, at = located(docs)
    dropped = deduplicate(docs).filter("not kept").select(F.col("at").alias("_at"))
    return docs.join(dropped, at == dropped["_at"], "left_anti")


def _folder_of(df: DataFrame) -> str:
    return df.inputFiles()[0].rsplit("/", 1)[0]


def _differing(docs: DataFrame, at: Column, text: Column, rows: DataFrame) -> DataFrame:
    """Hits whose bytes are not those of the row that stays: (at, digest, body).

    The text that stays is repeated once for every so many rows of its digest, so that a
    digest with a third of all rows is compared in as many tasks as it needs.
    """
    copies = F.ceil(F.col("n") / ROWS_PER_COPY)
    hits = rows.filter("n > 1").select("at", "digest", "keep", "n")
    body = docs.select(at.alias("at"), text.alias("body"))
    hits = materialize(
        hits.join(body, "at").select(
            "at",
            "digest",
            "body",
            (F.col("at") == F.col("keep.at")).alias("stays"),
            copies.alias("copies"),
            F.pmod(F.xxhash64("at"), copies).alias("copy"),
        ),
        "hits",
    )
    stays = hits.filter("stays").select(
        "digest",
        F.col("body").alias("kept_body"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"),
    )
    return (
        hits.filter("not stays")
        .join(stays, ["digest", "copy"])
        .filter(F.col("body") != F.col("kept_body"))
        .select("at", "digest", "body")
    )


def _regrouped(rows: DataFrame, differ: DataFrame) -> DataFrame:
    """``rows`` with those in ``differ`` moved from their digest's group to one of their own."""
    moved = differ.join(rows.select("at", "doc_id"), "at")
    groups = moved.groupBy("digest", "body").agg(F.min(first_row()).alias("keep"), F.count("*").alias("n"))
    moved = moved.join(groups, ["digest", "body"]).select("digest", "doc_id", "at", "keep", "n")
    fewer = differ.groupBy("digest").agg(F.count("*").alias("less"))
    rest = (
        rows.join(differ.select("at"), "at", "left_anti")
        .join(fewer, "digest", "left")
        .withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
    )
    return rest.select("digest", "doc_id", "at", "keep", "n").unionByName(moved)
