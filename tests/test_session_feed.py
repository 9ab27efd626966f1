"""The merged feed against a fold over whole streams; narrow buckets force many guesses and repairs."""

import random

import pytest
from folds import FeedFold

from feedlake.operators import bucketfold
from feedlake.operators.align import align_segments
from feedlake.operators.book import session_orders
from feedlake.operators.ordering import Lane
from feedlake.operators.session_feed import FeedRules, feed_events, replayed_range, session_feed, sessions, trigger_table

WEIGHTS = {
    "update": 40, "trade": 10, "snapshot": 12, "bad_snapshot": 2, "heartbeat": 12, "ack": 2, "trigger": 1, "error": 1,
    "request": 2, "disconnect": 3, "recovery_failed": 3, "mismatch": 3, "timeout": 1,
}
SCHEMA = "instrument_id bigint, arrival bigint, kind string, at_ns bigint, seq bigint"


def stream(seed, sizes=(500, 120, 60, 7, 1), weights=WEIGHTS, silence=0.05):
    """Rows (key, pos, kind, at, seq); the first key holds most of them."""
    rng, rows = random.Random(seed), []
    for key, size in enumerate(sizes):
        at, n = 1000, 10
        for pos in range(1, size + 1):
            at += rng.randint(0, 40) if rng.random() > silence else rng.randint(150, 900)
            kind = rng.choices(list(weights), list(weights.values()))[0]
            seq = None
            if kind in ("update", "trade"):
                n += 1 + (rng.random() < 0.04)
                seq = n
            elif kind == "snapshot":
                seq = n - rng.choice([0, 0, 1, 1, 2, 3, 9, -1])
            rows.append((key, pos, kind, at, seq))
    return rows


def folded(rows, slots, timeout, horizon):
    return {k: FeedFold(slots, timeout).run([r[1:] for r in rows if r[0] == k], horizon) for k in {r[0] for r in rows}}


@pytest.mark.parametrize("width", [5, 64, 1 << 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_all_triggers_and_outcomes(spark, seed, width):
    rows, rules, lane = stream(seed), FeedRules(True, 200, True, slots=6), Lane(width=width)
    horizon = max(r[3] for r in rows) + 700
    feed = spark.createDataFrame(rows, SCHEMA).repartition(5)
    events = feed_events(feed, rules, lane, horizon).cache()
    want = folded(rows, 6, 200, horizon)
    got = {(r.instrument_id, r.arrival, r.session_id, r.at_ns, r.cause, r.applied) for r in events.where("event = 'trigger'").collect()}
    assert got == {(k, *asked) for k, fold in want.items() for asked in fold.asked}
    assert {c for _, _, _, _, c, _ in got} >= {"timeout", "gap", "overflow", "refused", "request", "disconnect", "trigger", "error"}
    labelled = session_feed(feed, events, lane).collect()
    assert len(labelled) == len(rows)
    assert {(r.instrument_id, r.arrival): (r.session_id, r.disposition, r.gateway_seq) for r in labelled} == {
        (k, pos): label for k, fold in want.items() for pos, label in fold.labels.items()
    }
    events.unpersist()


def test_gap_at_a_first_document_resets_and_at_a_recovery_document_stays():
    """Vectors: boundary 638, one hole; the buffer keeps one slot free."""
    rules = FeedRules(True, slots=5)

    def run(rows):
        s, out = bucketfold.State(rules.initial()), []
        for pos, (kind, seq) in enumerate(rows, 1):
            out += rules.step(s, pos, (kind, None, seq))
        return [(e[2], e[3], e[4]) for e in out], s.fields["open"], s.fields["recovering"]

    hole = [("update", 637), ("update", 640), ("snapshot", 638)]
    assert run(hole) == ([("snapshot", None, None), ("trigger", "gap", True)], False, True)
    again = [*hole, ("update", 641), ("update", 643), ("snapshot", 640)]
    assert run(again)[0][2:] == [("snapshot", None, None), ("trigger", "gap", False)] and run(again)[1:] == (True, True)
    full = [("update", 700 + i) for i in range(5)]
    assert run(full) == ([("trigger", "overflow", True)], False, True)
    assert run([*full, *full, ("snapshot", 710)])[0][1:] == [("trigger", "overflow", False), ("ignored_snapshot", None, None)]
    assert replayed_range([[1, 637], [2, 638], [3, 639], [4, 641], [5, 642]], 638) == (3, 4)
    assert replayed_range([[1, 639], [2, 600], [3, 640]], 638) == (1, 2)
    assert replayed_range([[1, 630], [2, 638]], 638) == (None, None)


def test_level_feed_rules(spark):
    """Without a buffer: duplicates ask for recovery, bad documents of a closed gate change nothing."""
    rows = [(1, i, k, i * 10, None) for i, k in enumerate(["bad_snapshot", "update", "snapshot", "update", "snapshot", "snapshot", "bad_snapshot", "snapshot"], 1)]
    events = feed_events(spark.createDataFrame(rows, SCHEMA), FeedRules(False), Lane(width=2))
    got = sorted((r.arrival, r.event, r.cause, r.applied, r.session_id) for r in events.collect())
    assert got == [
        (3, "snapshot", None, None, 0), (5, "trigger", "duplicate", True, 1), (6, "snapshot", None, None, 1),
        (7, "trigger", "duplicate", True, 2), (8, "snapshot", None, None, 2),
    ]
    assert trigger_table(events, "instrument_id").where("reason_code = 'OUT_OF_ORDER_OR_INVALID_TRANSITION'").count() == 2


def test_empty_and_eventless_feeds(spark):
    rules = FeedRules(True, 200, True)
    empty = spark.createDataFrame([], SCHEMA)
    assert feed_events(empty, rules).count() == 0
    quiet = spark.createDataFrame([(1, 1, "update", 5, 1), (1, 2, "mismatch", 6, None)], SCHEMA)
    events = feed_events(quiet, rules)
    assert events.count() == 0
    assert sorted((r.arrival, r.session_id, r.disposition) for r in session_feed(quiet, events).collect()) == [(1, 0, "pre_snapshot"), (2, 0, "mismatch")]


def test_a_document_replaces_the_book(spark):
    """Orders of the old session and those the new document does not list are gone; what follows applies."""
    rows = [(1, i, k, i, s) for i, (k, s) in enumerate([("snapshot", 5), ("update", 6), ("request", None), ("update", 8), ("update", 9), ("snapshot", 8), ("update", 10)], 1)]
    feed, rules = spark.createDataFrame(rows, SCHEMA), FeedRules(True)
    events = feed_events(feed, rules)
    assert [(r.session_id, r.from_pos, r.accepted_at, r.live_from) for r in sessions(events).orderBy("session_id").collect()] == [(0, None, 1, None), (1, 3, 6, 5)]
    orders = spark.createDataFrame(
        [(1, 2, 70, "open", 9.0), (1, 4, 71, "open", 3.0), (1, 5, 72, "match", 2.0), (1, 7, 73, "done", 0.0)],
        "instrument_id bigint, arrival bigint, order_ref bigint, kind string, qty double",
    )
    orders = orders.selectExpr("*", "cast(qty as decimal(18,2)) as q").drop("qty").withColumnRenamed("q", "qty")
    sent = session_feed(feed, events).where("gateway_seq is not null and kind = 'update'").select("instrument_id", "arrival", "session_id")
    images = spark.createDataFrame(
        [(1, 1, 70, 1.0), (1, 6, 72, 5.0), (1, 6, 73, 4.0), (1, 6, 74, 7.0)], "instrument_id bigint, arrival bigint, order_ref bigint, qty double"
    ).selectExpr("instrument_id", "arrival", "order_ref", "cast(qty as decimal(18,2)) as qty")
    book = session_orders(orders.join(sent, ["instrument_id", "arrival"]), images, events).collect()
    assert sorted((r.order_ref, float(r.resting_qty)) for r in book) == [(72, 3.0), (74, 7.0)]
    waiting = feed_events(spark.createDataFrame([*rows, (1, 8, "error", 8, None)], SCHEMA), rules)
    assert session_orders(orders.join(sent, ["instrument_id", "arrival"]), images, waiting).count() == 0


@pytest.mark.parametrize("width", [3, 50, 1 << 20])
def test_segments_of_several_snapshots(spark, width):
    """0 to 5 pending snapshots per key; every delta is judged by the next one."""
    rng, rows, pending, want = random.Random(width), [], [], {}
    for key in range(9):
        n, taken, segment = 100, key % 6, []
        spots = sorted(rng.sample(range(5, 80), taken))
        for pos in range(1, 81):
            if pos in spots:
                boundary = n - rng.choice([0, 1, 2, 5, 40])
                pending.append((key, pos, boundary))
                live, gap = replayed_range([[p, s] for p, s in segment], boundary)
                for p, _ in segment:
                    early = "stale" if live is None or p < live else "replayed" if gap is None or p < gap else "gap" if p == gap else "dropped"
                    want[key, p] = ("overflow", pos) if len(segment) > 15 else (early, pos)
                segment = []
                continue
            n += 1 + (rng.random() < 0.1)
            rows.append((key, pos, n))
            segment.append((pos, n))
        want.update({(key, p): ("pending", None) for p, _ in segment})
    deltas = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, seq bigint").repartition(4)
    snapshots = spark.createDataFrame(pending, "instrument_id bigint, arrival bigint, boundary bigint")
    got = align_segments(deltas, snapshots, slots=16, lane=Lane(width=width)).collect()
    assert {(r.instrument_id, r.arrival): (r.outcome, r.snapshot_at) for r in got} == want and len(got) == len(rows)


def test_the_kinds_are_made_once(spark):
    from pyspark.sql import functions as F

    from feedlake.operators.session_feed import FeedRules, feed_events

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def kind(name):
        made.add(1)
        return name

    rows = [(1, i, k, i * 10) for i, k in enumerate(["ack", "heartbeat", "snapshot", "update", None, "trigger"], 1)]
    frames = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, k string, at_ns bigint").withColumn("kind", kind("k")).drop("k")
    events = feed_events(frames, FeedRules(buffered=False, timeout=100), horizon_ns=1000)
    assert {(r["arrival"], r["event"]) for r in events.collect()} >= {(3, "snapshot"), (6, "trigger")}
    assert made.value == len(rows)
