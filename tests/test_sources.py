"""Frame files as a table and as a stream."""

from pyspark.sql import functions as F

from feedlake.operators.l2 import classify_l2
from feedlake.session import fresh_path
from feedlake.sources.capture import last_n_overall
from feedlake.sources.frames import match_product, read_frames, stream_frames
from feedlake.streaming import start_keyed, write_once


def test_frames_read_and_stream_alike(spark):
    path, out = fresh_path(spark, "frames-test"), fresh_path(spark, "out")
    rows = [("L2", 7, "s", i, i * 10, '{"type":"heartbeat","product_id":"A"}', None) for i in range(20)]
    rows.append(("L2", 7, "s", 20, 200, None, bytearray(b"\x01")))
    schema = "venue string, instrument_id int, session_hint string, arrival bigint, ingress_ns bigint, payload string, payload_bin binary"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(path)
    table = read_frames(spark, path)
    assert table.count() == 21
    assert [r["arrival"] for r in last_n_overall(table, 3, "arrival").collect()] == [20, 19, 18]
    kinds = classify_l2(table.withColumn("symbol", F.lit("A"))).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds} == {"heartbeat": 20, "unknown": 1}
    stream = classify_l2(stream_frames(spark, path, files_per_trigger=2).withColumn("symbol", F.lit("A")))
    start_keyed(stream.select("arrival", "kind"), write_once(out), fresh_path(spark, "ckpt"), once=True).awaitTermination()
    assert spark.read.parquet(out).count() == 21


def test_product_match_keeps_unknown_instruments(spark):
    frames = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, "A"), (1, 3, None)], "instrument_id int, arrival bigint, product_id string")
    instruments = spark.createDataFrame([(1, "A")], "instrument_id int, exchange_symbol string")
    got = {(r["instrument_id"], r["arrival"]): r["product_match"] for r in match_product(frames, instruments).collect()}
    assert got == {(1, 1): True, (1, 2): False, (2, 1): False, (1, 3): False}
