"""Message traces: one ``sbe_base64=`` text line per message."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what every trace line starts its payload with.
PREFIX = "sbe_base64="


def trace_line(message: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.base64(message).try_cast("string"))


def parse_trace_line(line: Column) -> Column:
    """Message bytes of a line, wherever a logger put the payload; NULL without a payload."""
    return F.try_to_binary(F.nullif(F.regexp_extract(line, PREFIX + r"([A-Za-z0-9+/=]+)", 1), F.lit("")), F.lit("base64"))


def _rolled(lines: DataFrame, max_file_bytes: int) -> DataFrame:
    """Lines with the name of their file and their number: a task starts the next file where a line no longer fits."""

    def work(batches):
        task, number, size, line = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            names = []
            for length in pc.binary_length(batch.column(0)).to_pylist():
                taken = (length or 0) + 1
                if size and size + taken > max_file_bytes:
                    number, size = number + 1, 0
                size += taken
                names.append(f"{task:06d}-{number:06d}")
            place = pa.array(range(line, line + len(names)), pa.int64())
            line += len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), place], names=["value", "roll", "line"])

    rolled = lines.mapInArrow(work, "value string, roll string, line bigint")
    # The writer wants its folders in order; so the lines of a file keep theirs.
    return rolled.sortWithinPartitions("roll", "line").drop("line")


def write_trace(messages: DataFrame, path: str, max_file_bytes: int = 1 << 30, message: str = "message") -> None:
    """Write trace lines as gzip text files that roll by size, one folder ``roll=<task>-<number>`` each.

    No file holds more than ``max_file_bytes`` before compression (a line longer than that has a file of its own), and
    only the last file of a task is short of it by more than a line, however the lengths of lines are mixed.
    A task that runs again writes the same files.
    """
    lines = messages.select(F.regexp_replace(trace_line(F.col(message)), r"\s", "").alias("value"))
    writer = _rolled(lines, max_file_bytes).write.partitionBy("roll").option("compression", "gzip")
    writer.mode("errorifexists").text(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """``message`` (binary) of every line that carries a payload."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(parse_trace_line(F.col("value")).alias("message")).where(F.col("message").isNotNull())
