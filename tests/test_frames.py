"""Frame outcomes: our own frames, one per rule."""

import json

from pyspark.sql import functions as F

from feedlake.operators.l2 import classify_l2, flatten_levels
from feedlake.operators.l3 import classify_l3, flatten_rest_book, order_events, trades

BOOK = {"bids": [["21921.73", "0.06317902"]], "asks": [["21922.10", "0.42000000"]]}
ID_A, ID_B = "d50ec984-77a8-460a-b958-66f114b0de9b", "132fb6ae-456b-4654-b4e0-d681ac05cea1"


def frame(kind, product="BTC-USD", **fields):
    head = {"type": kind} | ({"product_id": product} if product else {})
    return json.dumps(head | fields)


def ack(*channels):
    return json.dumps({"type": "subscriptions", "channels": [{"name": n, "product_ids": p} for n, p in channels]})


def classified(spark, classify, payloads):
    rows = [(7, i, "BTC-USD", p) for i, p in enumerate(payloads)]
    return classify(spark.createDataFrame(rows, "instrument_id int, arrival bigint, symbol string, payload string"))


def kinds(spark, classify, payloads):
    return [r["kind"] for r in classified(spark, classify, payloads).orderBy("arrival").collect()]


def test_level_frames(spark):
    ours = ["ETH-USD", "BTC-USD"]
    cases = [
        (frame("snapshot", time="2023-02-09T20:33:09.5Z", **BOOK), "snapshot"),
        (frame("snapshot", bids=[], asks=[]), "snapshot"),
        (frame("snapshot", bids=[]), "bad_snapshot"),
        (frame("snapshot", bids=[["1", "2"], ["x", "1"]], asks=[]), "bad_snapshot"),
        (frame("snapshot", bids=[["1", "2"], ["3"]], asks=[]), "bad_snapshot"),
        (frame("snapshot", bids=[["1", "-2"]], asks=[["0", "0"]]), "snapshot"),
        (frame("snapshot", "ETH-USD", **BOOK), "mismatch"),
        (frame("snapshot", None, **BOOK), "mismatch"),
        (frame("l2update", changes=[["buy", "21921.73", "0.05000000"], ["sell", "21922.10", "0"]]), "update"),
        (frame("l2update", changes=[["hold", "1", "1"]]), "bad_update"),
        (frame("l2update", changes=[["buy", "1", "-1"]]), "bad_update"),
        (frame("l2update", changes=[["buy", "1"]]), "bad_update"),
        (frame("l2update", changes=[]), "update"),
        (frame("l2update"), "bad_update"),
        (frame("heartbeat", sequence=5), "heartbeat"),
        (frame("heartbeat", "ETH-USD"), "mismatch"),
        (ack(("level2", ours), ("heartbeat", ours)), "ack"),
        (ack(("x", []), ("heartbeat", ours), ("level2", ours)), "ack"),
        (ack(("level2", ours)), "trigger"),
        (ack(("level2", ["ETH-USD"]), ("heartbeat", ours)), "trigger"),
        # Only the first channel object of a name counts.
        (ack(("level2", []), ("level2", ours), ("heartbeat", ours)), "trigger"),
        ('{"type":"subscriptions"}', "trigger"),
        (frame("error", message="no"), "unknown"),
        (frame("status"), "unknown"),
        ('{"product_id":"BTC-USD"}', "malformed"),
        ("not json", "malformed"),
    ]
    assert kinds(spark, classify_l2, [p for p, _ in cases]) == [k for _, k in cases]


def test_levels_keep_the_written_scale(spark):
    payloads = [
        frame("snapshot", **BOOK),
        frame("l2update", time="1970-01-01T00:00:01Z", changes=[["buy", "21921.73", "0.05000000"], ["sell", "21922.10", "0"]]),
    ]
    rows = flatten_levels(classified(spark, classify_l2, payloads), "arrival", "exchange_ns").orderBy("arrival", "entry_pos")
    assert [tuple(r) for r in rows.collect()] == [
        (0, -1, 0, 1, 1, 2192173, 2, 6317902, 8),
        (0, -1, 1, 2, 1, 2192210, 2, 42000000, 8),
        (1, 10**9, 0, 1, 1, 2192173, 2, 5000000, 8),
        (1, 10**9, 1, 2, 2, 2192210, 2, 0, 0),
    ]


def test_entry_cap_rejects_only_the_oversize_message(spark):
    rows = [(7, i, "BTC-USD", p) for i, p in enumerate([frame("snapshot", **BOOK), frame("l2update", changes=[["buy", "1", "1"]])])]
    df = spark.createDataFrame(rows, "instrument_id int, arrival bigint, symbol string, payload string")
    got = classify_l2(df, max_entries=1).orderBy("arrival").select("kind", "over_cap", "entry_count").collect()
    assert [tuple(r) for r in got] == [("bad_snapshot", True, 0), ("update", False, 1)]


def test_binary_frames_are_unknown(spark):
    df = spark.createDataFrame([(1, 1, "S", None, b"x")], "instrument_id int, arrival bigint, symbol string, payload string, payload_bin binary")
    assert classify_l2(df).first()["kind"] == "unknown"
    assert classify_l3(df).first()["kind"] == "unknown"


def order(kind, **fields):
    base = {"time": "1970-01-01T00:00:01Z", "sequence": 50, "order_id": ID_A, "side": "buy"}
    return frame(kind, **(base | fields))


def test_order_frames(spark):
    match = {"maker_order_id": ID_A, "taker_order_id": ID_B, "sequence": 50, "side": "sell", "size": "5.23512", "price": "400.23"}
    cases = [
        (order("received", size="1.34", price="502.1", order_type="limit"), "update"),
        (order("received", funds="3000", order_type="market"), "update"),
        (order("received", size="bad", order_type="limit"), "bad_update"),
        (order("received", size="1"), "bad_update"),
        (order("open", price="200.2", remaining_size="1.00"), "update"),
        (order("open", price="200.2"), "bad_update"),
        (order("open", price="200.2", remaining_size="1.00", side="hold"), "bad_update"),
        (order("open", price="200.2", remaining_size="1.00", sequence=-1), "bad_update"),
        (order("open", price="200.2", remaining_size="1.00", order_id="zz"), "bad_update"),
        (order("open", price="200.2", remaining_size="1.00", order_id="0" * 32), "bad_update"),
        (order("done", reason="filled", remaining_size="0"), "update"),
        (order("done", reason="canceled", remaining_size="0", price="1"), "update"),
        (order("done", reason="lost", remaining_size="0"), "bad_update"),
        (order("activate", stop_price="335.00"), "update"),
        (order("activate"), "bad_update"),
        (order("change", price="1", new_size="5.23512", old_size="12.00000"), "update"),
        (order("change", price="1", new_size="5.23512"), "bad_update"),
        (frame("match", **match), "trade"),
        (frame("match", **(match | {"size": ""})), "bad_update"),
        (frame("heartbeat"), "heartbeat"),
        (frame("heartbeat", None), "malformed"),
        (frame("heartbeat", "X"), "mismatch"),
        (ack(("full", ["BTC-USD"]), ("heartbeat", ["BTC-USD"])), "ack"),
        (ack(("level2", ["BTC-USD"]), ("heartbeat", ["BTC-USD"])), "trigger"),
        (frame("error", None, message="x"), "error"),
        (frame("l2update"), "unknown"),
        ("{}", "malformed"),
    ]
    assert kinds(spark, classify_l3, [p for p, _ in cases]) == [k for _, k in cases]


def test_order_rows(spark):
    hi, lo = -3094314323176569334, -5091206193122058597
    payloads = [
        order("received", funds="3000", order_type="market"),
        order("done", reason="canceled", remaining_size="0.5", cancel_reason="101"),
        order("activate", stop_price="335.00", side="sell"),
        order("change", price=400.23, new_size="5.23512", old_size="12.00000"),
        frame("match", maker_order_id=ID_A, taker_order_id=ID_B, sequence=51, side="sell", size="5.23512", price="400.23"),
    ]
    events = classified(spark, classify_l3, payloads)
    got = order_events(events, "arrival").orderBy("arrival").collect()
    assert [tuple(r) for r in got] == [
        (0, 50, 10**9, hi, lo, 1, 1, 0, 2, 0, 0, 0, 0, 0, 0, 10**9),
        (1, 50, 10**9, hi, lo, 1, 1, 6, 0, 0, 0, 5, 1, 0, 0, 10**9),
        (2, 50, 10**9, hi, lo, 2, 1, 2, 3, 33500, 2, 0, 0, 0, 0, 10**9),
        (3, 50, 10**9, hi, lo, 1, 1, 3, 0, 40023, 2, 523512, 5, 1200000, 5, 10**9),
    ]
    trade = trades(events, "arrival").collect()
    assert len(trade) == 1
    assert (trade[0]["exchange_seq"], trade[0]["exchange_ns"], trade[0]["maker_high"], trade[0]["taker_side"]) == (51, -1, hi, 2)


def test_book_documents(spark):
    good = json.dumps({"sequence": 638, "bids": [["333.98", "5.72", ID_A]], "asks": [["334.1", "bad", ID_B]]})
    docs = [
        (1, good),
        (2, json.dumps({"sequence": 1, "bids": [["1", "1", ID_A], ["1", "1", "nope"]], "asks": []})),
        (3, json.dumps({"bids": [["1", "1", ID_A]], "asks": []})),
        (4, json.dumps({"sequence": 9, "bids": [], "asks": []})),
        (5, json.dumps({"sequence": 9, "bids": [["1", "2", ID_A]]})),
    ]
    rows = flatten_rest_book(spark.createDataFrame(docs, "doc int, payload string"), "doc").orderBy("doc", "entry_pos").collect()
    assert [(r["doc"], r["seq1"], r["entry_pos"], r["side"], r["price_m"], r["price_s"], r["qty_m"], r["qty_s"], r["order_ns"]) for r in rows] == [
        (1, 638, 0, 1, 33398, 2, 572, 2, -1),
        (1, 638, 1, 2, 3341, 1, 2**63 - 1, 0, -1),
        (5, 9, 0, 1, 1, 0, 2, 0, -1),
    ]


def test_documents_are_read_forwards_and_refused_whole(spark, tmp_path):
    from feedlake.operators.l3 import refused_documents
    from feedlake.sources.frames import read_rest_books

    bid, ask = f'"bids":[["1","2","{ID_A}"]]', f'"asks":[["3","4","{ID_B}"]]'
    docs = {
        "a": "{" + f'{bid},"sequence":5,{ask}' + "}",  # bids before the sequence are not seen
        "b": "{" + f'"sequence":6,{ask},{bid}' + "}",  # nor asks before the bids
        "c": "{" + f'"sequence":7,{ask}' + "}",
        "d": "{" + f'{bid},{ask}' + "}",
        "e": '{"sequence":8,"bids":[' + ",".join([f'["1","1","{ID_A}"]'] * 10_001) + "]}",
        "f": '{"sequence":9,"bids":[["1","1","nope"]]}',
    }
    for name, text in docs.items():
        (tmp_path / name).write_text(text)
    read = read_rest_books(spark, str(tmp_path))
    rows = flatten_rest_book(read, "path").collect()
    assert sorted((r.path[-1], r.seq1, r.side) for r in rows) == [("a", 5, 2), ("b", 6, 1), ("c", 7, 2)]
    refused = {(r.path[-1], r.kind, r.refused) for r in refused_documents(read, "path").collect()}
    assert refused == {("d", "trigger", "missing_sequence"), ("e", "trigger", "over_cap"), ("f", "trigger", "bad_order_id")}


def test_refused_documents_parse_each_document_once(spark):
    from feedlake.operators.l3 import refused_documents

    documents = spark.createDataFrame([(1, '{"sequence":7,"bids":[],"asks":[]}')], "doc int, payload string")
    plan = refused_documents(documents, "doc")._jdf.queryExecution().optimizedPlan().toString()
    once = flatten_rest_book(documents, "doc")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= once.count("regexp_extract(")
