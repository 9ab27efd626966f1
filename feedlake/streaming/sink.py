"""Streaming sinks and query starters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlake.operators.ordering import spread_join
from feedlake.session import ROCKSDB, delete_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def write_once(path: str, format: str = "parquet") -> Callable[[DataFrame, int], None]:
    """Idempotent batch sink: batch N overwrites its own folder, so a repeated batch adds nothing. It goes by the
    number of the batch alone; where a lost checkpoint cuts batches anew, use :func:`write_messages`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(format).save(f"{path}/batch={batch_id}")

    return write


def last_commit(spark: SparkSession, path: str) -> int:
    """Number of the last finished folder ``commit=`` under ``path``, -1 before the first one."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return -1
    names = [status.getPath() for status in files.listStatus(folder)]
    done = [p for p in names if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max((int(p.getName().split("=")[1]) for p in done), default=-1)


def write_messages(path: str, keys: Sequence[str] = ("instrument_id",)) -> Callable[[DataFrame, int], None]:
    """Batch sink by message identity: (keys, session, gateway sequence) is stored once, however batches are cut.

    Messages of a key come in the order of session and sequence (a reset has sequence 0), so one mark per key, its
    last stored message, tells what is new. A commit writes its messages and then the marks after them, which
    make it visible; what a failed commit left behind is overwritten by the next one. A batch that comes
    again, whole or in other pieces, under any number, adds nothing. One writer at a time.
    """
    keys = list(keys)
    place = F.struct("session_id", "gateway_seq")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = last_commit(spark, f"{path}/marks")
        turn = last + 1
        batch.persist()
        try:
            fresh, marks = batch, None
            if last >= 0:
                marks = spark.read.parquet(f"{path}/marks/commit={last}")
                fresh = spread_join(batch, marks, keys, "left", "gateway_seq")
                fresh = fresh.where(F.col("_mark").isNull() | (place > F.col("_mark"))).drop("_mark")
            # A message that is twice in one batch is stored once.
            fresh = fresh.dropDuplicates([*keys, "session_id", "gateway_seq"])
            fresh.write.mode("overwrite").parquet(f"{path}/data/commit={turn}")
            after = batch.groupBy(*keys).agg(F.max(place).alias("_mark"))
            if marks is not None:
                after = after.unionByName(marks).groupBy(*keys).agg(F.max("_mark").alias("_mark"))
            after.write.mode("overwrite").parquet(f"{path}/marks/commit={turn}")
            if last > 0:
                delete_folder(spark, f"{path}/marks/commit={last - 1}")
        finally:
            batch.unpersist()

    return write


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """The messages of all finished commits of :func:`write_messages`."""
    last = last_commit(spark, f"{path}/marks")
    if last < 0:
        raise ValueError(f"no finished commit in {path}")
    folders = [f"{path}/data/commit={n}" for n in range(last + 1)]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("commit")


def start_keyed(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start a stateful stream on the RocksDB state store; ``once`` drains what is there and stops."""
    conf = stream.sparkSession.conf
    previous = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        if previous is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, previous)
