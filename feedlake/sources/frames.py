"""Frame, instrument and book-document sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.operators.ordering import spread_join

FRAME_SCHEMA = (
    "venue string, instrument_id int, session_hint string, arrival bigint, ingress_ns bigint, "
    "payload string, payload_bin binary"
)


def read_frames(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Recorded frames: one row per frame, ``arrival`` unique per instrument."""
    return spark.read.schema(FRAME_SCHEMA).format(format).load(path)


def read_rest_books(spark: SparkSession, path: str) -> DataFrame:
    """Book documents, one per file: ``path`` and ``payload``, for ``flatten_rest_book``."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def stream_frames(spark: SparkSession, path: str, format: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    """The same table as a stream; the file limit bounds a micro-batch."""
    return (
        spark.readStream.schema(FRAME_SCHEMA)
        .format(format)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )


def stream_kafka_frames(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 1_000_000) -> DataFrame:
    """Frames of a topic with one key per instrument; needs the Kafka connector on the classpath.

    A partition is ordered and a key lives in one partition, so the offset is a unique position.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", offsets_per_trigger)
        .load()
    )
    return raw.select(
        F.col("key").cast("string").try_cast("int").alias("instrument_id"),
        F.col("offset").alias("arrival"),
        (F.unix_micros("timestamp") * 1_000).alias("ingress_ns"),
        F.col("value").cast("string").alias("payload"),
    )


def match_product(frames: DataFrame, instruments: DataFrame, product: str = "product_id") -> DataFrame:
    """Add ``symbol`` of the instrument and ``product_match``; unmatched rows are kept for the counters."""
    named = instruments.select("instrument_id", F.col("exchange_symbol").alias("symbol"))
    joined = spread_join(frames, named, ["instrument_id"], "left")
    return joined.withColumn("product_match", F.coalesce(F.col(product) == F.col("symbol"), F.lit(False)))


def check_instruments(instruments: DataFrame) -> DataFrame:
    """Violations ``(rule, exchange_symbol, instrument_id, occurrences)`` of an instrument table."""
    symbol, ident = F.col("exchange_symbol"), F.col("instrument_id")
    blank = symbol.isNull() | (F.trim(symbol) == "")
    columns = ("rule", "exchange_symbol", "instrument_id", "occurrences")

    def single(rule, bad):
        counted = instruments.where(bad).groupBy("exchange_symbol", "instrument_id").agg(
            F.count("*").alias("occurrences")
        )
        return counted.select(F.lit(rule).alias("rule"), *columns[1:])

    def repeated(rule, key, bad):
        return (
            instruments.where(~bad)
            .groupBy(key)
            .agg(F.count("*").alias("occurrences"))
            .where("occurrences > 1")
            .select(
                F.lit(rule).alias("rule"),
                (symbol if key == "exchange_symbol" else F.lit(None).cast("string")).alias("exchange_symbol"),
                (ident if key == "instrument_id" else F.lit(None).cast("bigint")).alias("instrument_id"),
                "occurrences",
            )
        )

    return (
        single("blank_symbol", blank)
        .unionByName(single("id_not_positive", ident <= 0))
        .unionByName(repeated("duplicate_symbol", "exchange_symbol", blank))
        .unionByName(repeated("duplicate_id", "instrument_id", ident.isNull()))
    )
