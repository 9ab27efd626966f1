"""Bucketed folds against per-row folds; narrow buckets force many of them, one key dominates."""

import random

import pytest
from folds import liveness_fold, session_fold
from pyspark.sql import functions as F

from feedlake.operators.align import align_deltas, buffer_overflow, sequence_gaps
from feedlake.operators.book import change_conflicts, resting_orders
from feedlake.operators.counters import active_connections, latency_stats
from feedlake.operators.liveness import liveness_timeouts
from feedlake.operators.ordering import Lane, dense_arrival, max_before, max_upto, running, spread_join, sum_before, sum_upto
from feedlake.operators.session_state import apply_session_rules, emit_messages, emit_resets, order_violations
from feedlake.sources.capture import last_n

KINDS = ["snapshot", "bad_snapshot", "update", "bad_update", "heartbeat", "ack", "trigger", "error", "mismatch", "trade"]


def streams(seed, pick, sizes=(400, 90, 60, 5, 1)):
    """Rows (key, position, value); the first key holds most of the rows."""
    rng = random.Random(seed)
    return [(key, pos, pick(rng)) for key, n in enumerate(sizes) for pos in range(1, n + 1)]


def by_key(rows):
    out = {}
    for key, pos, value in rows:
        out.setdefault(key, []).append((pos, value))
    return out


@pytest.mark.parametrize("lane", [Lane(width=7), Lane(width=1 << 20), Lane(width=3, sparse=True)])
def test_running(spark, lane):
    rows = streams(1, lambda r: r.randint(-5, 9))
    if lane.sparse:
        rows = [(k, p * p * 1000, v) for k, p, v in rows]
    df = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, v bigint").repartition(5)
    got = running(
        df, lane, su=sum_upto(F.col("v")), sb=sum_before(F.col("v")), mu=max_upto(F.col("v")),
        mb=max_before(F.struct("arrival", "v")),
    ).collect()
    want = {}
    for key, seq in by_key(rows).items():
        total, best, prev = 0, None, None
        for pos, v in seq:
            best = v if best is None else max(best, v)
            want[key, pos] = (total + v, total, best, prev)
            total, prev = total + v, (pos, v)
    assert len(got) == len(rows)
    assert {(r["instrument_id"], r["arrival"]): (r["su"], r["sb"], r["mu"], tuple(r["mb"]) if r["mb"] else None) for r in got} == want


def test_dense_arrival_splits_large_groups(spark):
    rng = random.Random(4)
    rows = [(0 if i % 3 else i % 7, rng.randint(0, 5), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, id bigint").repartition(6)
    got = dense_arrival(df, ["k"], ["t", "id"]).collect()
    want, count = {}, {}
    for k, t, i in sorted(rows):
        count[k] = count.get(k, 0) + 1
        want[i] = count[k]
    assert {r["id"]: r["arrival"] for r in got} == want


@pytest.mark.parametrize("width", [4, 1 << 20])
@pytest.mark.parametrize("seed", [2, 3])
def test_session_rules(spark, width, seed):
    rows = streams(seed, lambda r: r.choice(KINDS))
    df = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, kind string").repartition(5)
    got = apply_session_rules(df, Lane(width=width)).collect()
    want = {}
    for key, seq in by_key(rows).items():
        for (pos, _), state in zip(seq, session_fold([k for _, k in seq]), strict=True):
            want[key, pos] = state
    columns = ("open_before", "open_after", "attempt", "ignored", "session_id", "gateway_seq")
    assert {(r["instrument_id"], r["arrival"]): tuple(r[c] for c in columns) for r in got} == want


@pytest.mark.parametrize("width", [4, 1 << 20])
def test_session_rules_with_failed_recoveries(spark, width):
    rows = streams(5, lambda r: r.choice([*KINDS, "recovery_failed", "timeout"]))
    df = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, kind string")
    got = apply_session_rules(df, Lane(width=width), failures=True).collect()
    want = {}
    for key, seq in by_key(rows).items():
        for (pos, _), state in zip(seq, session_fold([k for _, k in seq]), strict=True):
            want[key, pos] = state[2:]
    assert {(r["instrument_id"], r["arrival"]): (r["attempt"], r["ignored"], r["session_id"], r["gateway_seq"]) for r in got} == want


def test_message_order_contract(spark):
    rows = streams(6, lambda r: r.choice(KINDS))
    df = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, kind string")
    ruled = apply_session_rules(df, Lane(width=9)).withColumns({"exchange_ns": F.lit(-1), "entry_count": F.lit(1)})
    messages = emit_resets(ruled, "instrument_id", "arrival").unionByName(emit_messages(ruled, "instrument_id", "arrival"))
    assert order_violations(messages, Lane(width=9)).count() == 0
    swapped = messages.withColumn("event_type", F.when(F.col("event_type") == 1, 3).otherwise(F.col("event_type")))
    assert order_violations(swapped, Lane(width=9)).count() > 0


def test_alignment_vectors(spark):
    cases = {
        1: ([636, 637, 638, 639, 640], ["stale", "stale", "stale", "replayed", "replayed"]),
        2: ([637, 640, 641], ["stale", "gap", "dropped"]),
        3: ([639, 641, 642], ["replayed", "gap", "dropped"]),
        4: ([630, 638], ["stale", "stale"]),
        # A sequence below the boundary after the first live one is a break, not stale.
        5: ([639, 600, 640], ["replayed", "gap", "dropped"]),
    }
    rows = [(k, i + 1, s) for k, (seqs, _) in cases.items() for i, s in enumerate(seqs)]
    deltas = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, seq bigint")
    snapshots = spark.createDataFrame([(k, 638) for k in cases], "instrument_id bigint, boundary bigint")
    for width in (1, 2, 1 << 20):
        got = align_deltas(deltas, snapshots, Lane(width=width)).orderBy("instrument_id", "arrival").collect()
        outcome = {k: [r["outcome"] for r in got if r["instrument_id"] == k] for k in cases}
        assert outcome == {k: want for k, (_, want) in cases.items()}


def test_overflow_keeps_one_slot_free(spark):
    deltas = spark.createDataFrame([(k, i, i) for k, n in ((1, 4), (2, 5)) for i in range(n)], "instrument_id bigint, arrival bigint, seq bigint")
    snapshots = spark.createDataFrame([(1, 100), (2, 100)], "instrument_id bigint, arrival bigint")
    got = {r["instrument_id"]: r["overflow"] for r in buffer_overflow(deltas, snapshots, slots=5).collect()}
    assert got == {1: False, 2: True}


def test_sequence_gaps(spark):
    rows = streams(8, lambda r: r.randint(1, 30))
    df = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, seq bigint")
    got = {(r["instrument_id"], r["arrival"]): (r["missing"], r["out_of_order"]) for r in sequence_gaps(df, lane=Lane(width=5)).collect()}
    for key, seq in by_key(rows).items():
        prev = None
        for pos, s in seq:
            assert got[key, pos] == (max(0, s - prev - 1) if prev is not None else 0, prev is not None and s <= prev)
            prev = s


@pytest.mark.parametrize("restart", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_liveness(spark, restart, seed):
    rng = random.Random(seed)
    rows, want = [], set()
    kinds = ["ack", "heartbeat", "heartbeat", "heartbeat", "update", "snapshot", "snapshot", "trigger", "disconnect", "bad_snapshot", "recovery_failed"]
    for key, n in ((0, 400), (1, 80), (2, 3)):
        at, mine = 0, []
        for pos in range(1, n + 1):
            at += rng.choice([1, 2, 5, 9, 11, 14, 17, 40])
            kind = rng.choice(kinds)
            rows.append((key, pos, kind, at))
            mine.append((at, kind))
        want |= {(key, *hit) for hit in liveness_fold(mine, 10, 9000, restart)}
    assert {applied for _, _, applied in want} == {False, True}
    df = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, kind string, at_ns bigint")
    for width in (6, 1 << 20):
        got = liveness_timeouts(df, 10, F.lit(9000), Lane(width=width), restart=restart).collect()
        assert {(r["instrument_id"], r["fired_ns"], r["applied"]) for r in got} == want
        assert len(got) == len(want)


def test_liveness_follows_recoveries(spark):
    """An applied recovery of any cause ends the monitoring; an ignored timeout is repeated."""
    cases = {
        1: [(0, "ack"), (5, "trigger")],  # stopped before the first check
        2: [(0, "ack"), (1, "snapshot"), (2, "snapshot"), (3, "ack")],  # duplicate snapshot, then acknowledged again
        3: [(0, "trigger"), (1, "ack")],  # recovery stays open: ignored timeouts every ten
        4: [(0, "ack"), (1, "snapshot")],  # applied once, then silence
    }
    rows = [(k, i, kind, at) for k, each in cases.items() for i, (at, kind) in enumerate(each)]
    df = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, kind string, at_ns bigint")
    got = {(r.instrument_id, r.fired_ns, r.applied) for r in liveness_timeouts(df, 10, F.lit(45)).collect()}
    assert got == {(2, 13, False), (2, 23, False), (2, 33, False), (2, 43, False), (3, 11, False), (3, 21, False), (3, 31, False), (3, 41, False), (4, 10, True)}


def test_latency_minimum_restarts_after_zero(spark):
    rows = [(1, i + 1, v) for i, v in enumerate([5, 3, 0, 9, 7])] + [(2, 1, 4), (2, 2, 0)] + [(3, 1, 8), (3, 2, 6)]
    df = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, latency bigint")
    for width in (2, 1 << 20):
        got = {r["instrument_id"]: (r["latency_min"], r["latency_max"], r["latency_last"]) for r in latency_stats(df, Lane(width=width)).collect()}
        assert got == {1: (7, 9, 7), 2: (0, 4, 0), 3: (6, 8, 6)}


def test_connection_gauge_ignores_repeated_edges(spark):
    rows = streams(9, lambda r: r.choice(["open", "close", "other"]))
    df = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, e string")
    got = {r["instrument_id"]: r["active_connections"] for r in active_connections(df, Lane(width=3), F.col("e") == "open", F.col("e") == "close").collect()}
    for key, seq in by_key(rows).items():
        edges = [e for _, e in seq if e != "other"]
        if edges:
            assert got[key] == int(edges[-1] == "open")


def test_resting_orders_and_conflicts(spark):
    rng = random.Random(11)
    rows, size = [], {}
    conflicts = set()
    for pos in range(1, 601):
        ref = 0 if pos % 3 else rng.randint(0, 6)
        kind = rng.choice(["received", "open", "change", "done", "match", "activate"])
        qty, old = rng.randint(1, 20), rng.randint(1, 4)
        rows.append((1, ref, pos, kind, qty, old))
        if kind == "change" and size.get(ref) != old:
            conflicts.add(pos)
        if kind in ("open", "change"):
            size[ref] = qty
        elif kind == "done":
            size[ref] = None
        elif kind == "match" and size.get(ref) is not None:
            size[ref] -= qty
    df = spark.createDataFrame(rows, "instrument_id bigint, order_ref bigint, arrival bigint, kind string, qty int, old int").select(
        "instrument_id", "order_ref", "arrival", "kind", F.col("qty").cast("decimal(18,2)"), F.col("old").cast("decimal(18,2)").alias("old_qty")
    )
    for width in (8, 1 << 20):
        lane = Lane(keys=("instrument_id", "order_ref"), width=width)
        got = {r["order_ref"]: int(r["resting_qty"]) for r in resting_orders(df, lane).collect()}
        assert got == {k: v for k, v in size.items() if v is not None}
        assert {r["arrival"] for r in change_conflicts(df, lane).collect()} == conflicts


def test_last_n_and_spread_join(spark):
    rows = streams(12, lambda r: r.randint(0, 9))
    df = spark.createDataFrame(rows, "instrument_id bigint, arrival bigint, v bigint")
    got = last_n(df, 3, Lane(width=5)).collect()
    for key, seq in by_key(rows).items():
        mine = sorted((r["age"], r["arrival"], r["v"]) for r in got if r["instrument_id"] == key)
        assert mine == [(i + 1, p, v) for i, (p, v) in enumerate(reversed(seq[-3:]))]
        assert {r["total"] for r in got if r["instrument_id"] == key} == {len(seq)}
    small = spark.createDataFrame([(0, "a"), (1, "b")], "instrument_id bigint, name string")
    assert spread_join(df, small, ["instrument_id"]).count() == sum(1 for k, _, _ in rows if k < 2)
    assert spread_join(df, small, ["instrument_id"], "left").count() == len(rows)


def test_a_hot_key_is_spread_over_its_buckets(spark):
    """The shuffle of the folds is by (key, bucket), never by the key alone."""
    df = spark.range(10_000).select(F.lit(1).cast("bigint").alias("instrument_id"), F.col("id").alias("arrival"), F.lit("update").alias("kind"))
    by_key_only = df.repartition("instrument_id")
    lane = Lane(width=100)
    placed = lane.bucketed(by_key_only)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = placed.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 10_000
    assert apply_session_rules(by_key_only, lane).where("disposition <> 'pre_snapshot'").count() == 0


def test_a_table_repeated_per_salt_is_not_broadcast_by_its_size_before(spark, tmp_path):
    path = str(tmp_path / "small")
    spark.range(50_000).select(F.col("id").alias("instrument_id"), (F.col("id") * 7919 % 50_021).alias("v")).coalesce(1).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "small").glob("*.parquet"))
    big = spark.range(1000).select((F.col("id") % 10).alias("instrument_id"), F.col("id").alias("arrival"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(4 * size))
    try:
        joined = spread_join(big, spark.read.parquet(path), ["instrument_id"], "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_segments_are_held_without_salts(spark):
    from feedlake.operators.align import align_segments

    deltas = spark.createDataFrame([(1, i, i) for i in range(1, 8) if i != 4], "instrument_id bigint, arrival bigint, seq bigint")
    snapshots = spark.createDataFrame([(1, 4, 3)], "instrument_id bigint, arrival bigint, boundary bigint")
    told = align_segments(deltas, snapshots, slots=3, lane=Lane(width=2))
    assert {r["arrival"]: r["outcome"] for r in told.collect()} == dict.fromkeys((1, 2, 3), "overflow") | dict.fromkeys((5, 6, 7), "pending")
    assert "_salt" not in told._jdf.queryExecution().optimizedPlan().toString()
