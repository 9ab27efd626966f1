"""Wire goldens, control messages, traces, metrics text, instrument checks."""

import base64
import random
import struct

import pytest
from pyspark.sql import functions as F

from feedlake.operators.recovery import batch_result, duplicate_routes, route_requests
from feedlake.operators.wire import decode_entries, decode_messages, decode_requests, encode_messages, encode_request, encode_request_batch
from feedlake.session import fresh_path
from feedlake.sources.frames import check_instruments
from feedlake.sources.metrics import to_prometheus
from feedlake.sources.trace import read_trace, write_trace
from feedlake.venues import FEEDS, register_feed

BODY = "event_type int, venue int, book_depth int, instrument_id int, gateway_seq bigint, seq1 bigint, seq2 bigint, exchange_ns bigint, ingress_ns bigint"
LEVEL = "array<struct<side int, action int, price_m bigint, price_s int, qty_m bigint, qty_s int>>"


def prefix(template, entries, event, venue, depth, ident, seq, s1, s2, ex, ing, block=51):
    return struct.pack("<HBBHHBBBiqqqqqI", 0xEB0B, 2, template, block, entries, event, venue, depth, ident, seq, s1, s2, ex, ing, 0)


def level_table(spark):
    rows = [
        (2, 1, 2, 1001, 1, 1, 1, -1, 77, [(1, 1, 2192173, 2, 6317902, 8), (2, 1, 2192210, 2, -5, 1)]),
        (3, 1, 2, -7, 2, 2, 2, 10**18, 78, []),
        (3, 1, 2, 1001, 3, 3, 3, 5, 79, [(2, 2, 1, 0, 0, 0)]),
    ]
    return spark.createDataFrame(rows, f"{BODY}, entries {LEVEL}").coalesce(1)


def test_level_messages_byte_for_byte(spark):
    got = [bytes(r["message"]) for r in encode_messages(level_table(spark), 1, "gateway_seq").orderBy("gateway_seq").collect()]
    entry = lambda *v: struct.pack("<BBBBqq", *v)
    assert got == [
        prefix(1, 2, 2, 1, 2, 1001, 1, 1, 1, -1, 77) + entry(1, 1, 2, 8, 2192173, 6317902) + entry(2, 1, 2, 1, 2192210, -5),
        prefix(1, 0, 3, 1, 2, -7, 2, 2, 2, 10**18, 78),
        prefix(1, 1, 3, 1, 2, 1001, 3, 3, 3, 5, 79) + entry(2, 2, 0, 0, 1, 0),
    ]
    assert [len(m) for m in got] == [99, 59, 79]


def test_decode_reads_by_block_length_and_flags_bad_messages(spark):
    good = prefix(1, 1, 3, 1, 2, 5, 1, 2, 3, -1, 4) + struct.pack("<BBBBqq", 1, 1, 2, 3, -9, 10)
    longer = prefix(1, 1, 3, 1, 2, 6, 1, 2, 3, -1, 4, block=55) + b"\x01\x02\x03\x04" + struct.pack("<BBBBqq", 2, 2, 0, 0, 7, 8)
    bad = [b"", good[:58], b"\x00" + good[1:], good[:2] + b"\x01" + good[3:], good[:-1], good[:3] + b"\x09" + good[4:]]
    rows = [(i, bytearray(m)) for i, m in enumerate([good, longer, *bad])] + [(99, None)]
    df = spark.createDataFrame(rows, "n int, message binary").repartition(3)
    heads = {r["n"]: (r["valid"], r["instrument_id"]) for r in decode_messages(df, "n").collect()}
    assert heads[0] == (True, 5) and heads[1] == (True, 6)
    assert all(heads[n] == (False, None) for n in [2, 3, 4, 5, 6, 7, 99])
    entries = decode_entries(df, 1, "n").orderBy("n").collect()
    assert [(r["n"], r["entry_pos"], r["side"], r["action"], r["price_m"], r["qty_m"]) for r in entries] == [(0, 0, 1, 1, -9, 10), (1, 0, 2, 2, 7, 8)]


def test_order_and_trade_layouts(spark):
    fields = "id_high bigint, id_low bigint, side int, action int, reason int, order_type int, price_s int, qty_s int, old_qty_s int, order_ns bigint, price_m bigint, qty_m bigint, old_qty_m bigint"
    row = (-1, 2, 1, 1, 6, 2, 3, 4, 5, -1, 100, 200, 300)
    df = spark.createDataFrame([(3, 2, 3, 9, 1, 50, 50, 11, 12, [row])], f"{BODY}, entries array<struct<{fields}>>")
    coded = encode_messages(df, 2, "seq1")
    assert bytes(coded.first()["message"]) == prefix(2, 1, 3, 2, 3, 9, 1, 50, 50, 11, 12) + struct.pack("<qqBBBBBBBqqqq", *row)
    assert tuple(decode_entries(coded, 2, "seq1").select(*[f.split()[0] for f in fields.split(", ")]).first()) == row
    fields = "maker_high bigint, maker_low bigint, taker_high bigint, taker_low bigint, taker_side int, price_s int, qty_s int, price_m bigint, qty_m bigint"
    row = (1, -2, 3, -4, 2, 2, 5, 40023, 523512)
    df = spark.createDataFrame([(4, 2, 3, 9, 2, 51, 51, 11, 12, [row])], f"{BODY}, entries array<struct<{fields}>>")
    coded = encode_messages(df, 3, "seq1")
    message = bytes(coded.first()["message"])
    assert len(message) == 110 and message[59:] == struct.pack("<qqqqBBBqq", *row)
    assert tuple(decode_entries(coded, 3, "seq1").select(*[f.split()[0] for f in fields.split(", ")]).first()) == row


def test_recovery_requests(spark):
    text = "lost sync é"
    raw = text.encode()
    single = struct.pack("<HBBHHBBBBiqH", 0xEB0B, 2, 101, 18, 0, 1, 1, 5, 0, 1001, 123456789, len(raw)) + raw
    batch = struct.pack("<HBBHHBBBBqH", 0xEB0B, 2, 102, 14, 3, 2, 3, 6, 0, -5, 0) + struct.pack("<iii", 7, -8, 9)
    lit = F.lit
    one = spark.range(1).select(
        encode_request(lit(1), lit(1001), lit(1), lit(5), lit(123456789), lit(text)).alias("s"),
        encode_request_batch(lit(2), F.array(lit(7), lit(-8), lit(9)), lit(3), lit(6), lit(-5)).alias("b"),
        encode_request_batch(lit(2), F.array().cast("array<int>"), lit(3), lit(6), lit(-5)).alias("none"),
        encode_request(lit(1), lit(1), lit(1), lit(1), lit(1), F.repeat(lit("x"), lit(65_536))).alias("long"),
    ).first()
    assert bytes(one["s"]) == single and bytes(one["b"]) == batch and one["none"] is None and one["long"] is None

    def patched(message, at, value):
        return message[:at] + bytes([value]) + message[at + 1 :]

    bad = [
        single[:-1], single + b"\0", single[:7], b"", patched(single, 0, 0), patched(single, 2, 1), patched(single, 3, 1),
        patched(single, 4, 17), patched(single, 6, 1), patched(single, 8, 9), patched(single, 9, 4), patched(single, 10, 7),
        patched(batch, 6, 0), patched(batch, 6, 4), batch[:22] + b"",
    ]
    rows = [(i, bytearray(m)) for i, m in enumerate([single, batch, *bad])]
    got = decode_requests(spark.createDataFrame(rows, "n int, message binary"), "n").orderBy("n", "instrument_id").collect()
    fine = [tuple(r) for r in got if not r["malformed"]]
    assert fine == [
        (0, False, 1, 1, 5, 123456789, text, 1001),
        (1, False, 2, 3, 6, -5, None, -8), (1, False, 2, 3, 6, -5, None, 7), (1, False, 2, 3, 6, -5, None, 9),
    ]
    assert [r["n"] for r in got if r["malformed"]] == list(range(2, 2 + len(bad)))


def test_routing(spark):
    requests = spark.createDataFrame([(1, 1, 10), (2, 1, 99), (3, 2, 10)], "request_id bigint, venue int, instrument_id int")
    connectors = spark.createDataFrame([(1, 10), (1, 11)], "venue int, instrument_id int")
    routed = route_requests(requests, connectors, own_venue=1)
    assert {r["request_id"]: r["outcome"] for r in routed.collect()} == {1: "accepted", 2: "unknown", 3: "rejected"}
    assert tuple(batch_result(routed).first()) == (3, 1, 1, 1, 0)
    assert duplicate_routes(connectors).count() == 0
    assert duplicate_routes(connectors.unionByName(connectors.limit(1))).count() == 1


def test_trace_round_trip(spark, tmp_path):
    coded = encode_messages(level_table(spark), 1, "gateway_seq")
    path = fresh_path(spark, "trace-test")
    largest = 200  # a trace line of the test messages is shorter
    write_trace(coded.coalesce(1), path, max_file_bytes=largest + largest // 2)  # holds two lines, not three
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert all(line.startswith("sbe_base64=") for line in lines) and len(lines) == 3
    assert max(map(len, lines)) <= largest and sum(map(len, lines)) > largest + largest // 2
    assert spark.read.text(path).select(F.col("_metadata.file_path")).distinct().count() >= 2
    want = {bytes(r["message"]) for r in coded.collect()}
    assert {bytes(r["message"]) for r in read_trace(spark, path).collect()} == want
    logged = tmp_path / "log.txt"
    logged.write_text("12:00 INFO sbe_base64=" + base64.b64encode(b"abc").decode() + "\nother line\n")
    assert [bytes(r["message"]) for r in read_trace(spark, str(logged)).collect()] == [b"abc"]


def test_traces_fill_their_files_with_mixed_line_lengths(spark):
    rng, limit = random.Random(9), 4000
    lengths = [rng.choice([1, 10, 60, 400, 2500, 4200]) for _ in range(300)]
    rows = spark.createDataFrame([(i, bytes([i % 256]) * n) for i, n in enumerate(lengths)], "i int, message binary").coalesce(1)
    path = fresh_path(spark, "trace-test")
    write_trace(rows, path, max_file_bytes=limit)
    read = spark.read.option("recursiveFileLookup", "true").text(path)
    files = {}
    for r in read.select("value", F.col("_metadata.file_path").alias("file")).collect():
        files.setdefault(r.file, []).append(len(r.value) + 1)
    sizes = [sum(v) for _, v in sorted(files.items())]
    assert sum(map(len, files.values())) == 300
    assert all(n <= limit or len(files[f]) == 1 for f, n in zip(sorted(files), sizes, strict=True))
    # Each file is short of the limit by less than the first line of the next one.
    heads = [v[0] for _, v in sorted(files.items())]
    assert all(n + head > limit for n, head in zip(sizes, heads[1:], strict=False))
    assert {bytes(r.message) for r in read_trace(spark, path).collect()} == {bytes(r.message) for r in rows.collect()}


def test_metrics_text(spark):
    rows = [("gateway_frames_received,instanceId=a\"b,venue=L2,instrumentId=7", 5), ("bad name!", -1), ("", 3)]
    got = [r["line"] for r in to_prometheus(spark.createDataFrame(rows, "label string, value bigint"), "gateway_counter_9").collect()]
    assert got == ['gateway_frames_received{instance_id="a\\"b",venue="L2",instrument_id="7"} 5', "bad_name -1", "gateway_counter_9 3"]


def test_instrument_rules(spark):
    rows = [("BTC-USD", 1), ("BTC-USD", 2), (" ", 3), (None, 4), ("X", 0), ("Y", 5), ("Z", 5)]
    got = {(r["rule"], r["exchange_symbol"], r["instrument_id"]) for r in check_instruments(spark.createDataFrame(rows, "exchange_symbol string, instrument_id bigint")).collect()}
    assert got == {
        ("duplicate_symbol", "BTC-USD", None), ("blank_symbol", " ", 3), ("blank_symbol", None, 4),
        ("id_not_positive", "X", 0), ("duplicate_id", None, 5),
    }


def test_feeds_are_pluggable(spark):
    assert set(FEEDS) >= {"COINBASE_L2", "COINBASE_L3"}
    with pytest.raises(ValueError):
        register_feed("COINBASE_L2", FEEDS["COINBASE_L2"])


def test_encoding_cuts_large_batches(spark, monkeypatch):
    import pyarrow as pa

    from feedlake.operators.wire import _portions

    entries = pa.array([[{"a": 1}] * n for n in (3, 0, 5, 1, 40, 2)])
    batch = pa.RecordBatch.from_arrays([entries], names=["_e"])
    parts = list(_portions(batch, 10, 4, limit=60))
    assert [p.num_rows for p in parts] == [2, 2, 1, 1]
    assert [v for p in parts for v in p.column(0).to_pylist()] == entries.to_pylist()
