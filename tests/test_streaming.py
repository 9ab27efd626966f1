"""Streams against the per-row folds: several micro-batches, timers, late rows, repeated batches."""

import random
import time

import pandas as pd
from folds import FeedFold, session_fold
from pyspark.sql import functions as F

from feedlake.operators.ordering import Lane
from feedlake.operators.session_feed import FeedRules
from feedlake.session import fresh_path
from feedlake.streaming import (
    feed_messages,
    fold_batches,
    keyed_sessions,
    latest_orders,
    read_messages,
    resume_session_rules,
    start_keyed,
    stream_orders,
    write_messages,
    write_once,
)
from feedlake.streaming.keyed import in_order

KINDS = ["snapshot", "bad_snapshot", "update", "heartbeat", "ack", "trigger", "error", "mismatch"]
SCHEMA = "instrument_id bigint, arrival bigint, kind string, at_ns bigint, event_time timestamp"


def layout(spark, rows, pieces):
    path = fresh_path(spark, "stream-test")
    size = -(-len(rows) // pieces)
    for i in range(0, len(rows), size):
        part = spark.createDataFrame(rows[i : i + size], "instrument_id bigint, arrival bigint, kind string, at_ns bigint")
        part.withColumn("event_time", F.timestamp_micros(F.expr("at_ns div 1000"))).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def random_rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([0, 0, 1, 2]), i, rng.choice(KINDS), i * 10**9) for i in range(1, n + 1)]


def expected(rows):
    want = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        for row, state in zip(mine, session_fold([r[2] for r in mine]), strict=True):
            want[row[1]] = state
    return want


def outcome(df):
    names = ("open_before", "open_after", "attempt", "ignored", "session_id", "gateway_seq")
    return {r["arrival"]: tuple(r[n] for n in names) for r in df.collect()}


def test_keyed_state_equals_the_fold(spark):
    rows = random_rows(1, 300)
    out = fresh_path(spark, "out")
    start_keyed(keyed_sessions(layout(spark, rows, 4)), write_once(out), fresh_path(spark, "ckpt"), once=True).awaitTermination()
    assert outcome(spark.read.parquet(out)) == expected(rows)


def test_folded_batches_equal_the_fold(spark):
    rows = random_rows(2, 300)
    out, state = fresh_path(spark, "out"), fresh_path(spark, "state")
    step = fold_batches(spark, state, write_once(out), Lane(width=16))

    def twice(batch, batch_id):
        # A repeated batch must change nothing.
        step(batch, batch_id)
        step(batch, batch_id)

    start_keyed(layout(spark, rows, 4), twice, fresh_path(spark, "ckpt"), once=True).awaitTermination()
    assert outcome(spark.read.parquet(out)) == expected(rows)


def test_resume_from_any_cut(spark):
    rows = random_rows(3, 60)
    schema = "instrument_id bigint, arrival bigint, kind string, at_ns bigint"
    empty = spark.createDataFrame([], "instrument_id bigint, last_arrival bigint, is_open boolean, recovering boolean, session bigint, seq bigint")
    want = expected(rows)
    for cut in (7, 30):
        first, state = resume_session_rules(spark.createDataFrame(rows[:cut], schema), empty, Lane(width=8))
        second, _ = resume_session_rules(spark.createDataFrame(rows[cut:], schema), state, Lane(width=8))
        assert outcome(first) | outcome(second) == want


def test_timers_and_late_rows(spark):
    second = 10**9
    rows = [
        (1, 1, "ack", 1 * second), (1, 2, "snapshot", 2 * second), (1, 3, "update", 3 * second), (2, 4, "heartbeat", 4 * second),
        (1, 2, "update", 5 * second),  # behind its stream: counted, not applied
        (2, 5, "heartbeat", 400 * second), (1, None, "tick", 60 * second), (1, None, "tick", 62 * second),
    ]
    out = fresh_path(spark, "out")
    stream = keyed_sessions(layout(spark, rows, 8), timeout_ns=60 * second)
    start_keyed(stream, write_once(out), fresh_path(spark, "ckpt"), once=True).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).where("instrument_id = 1").orderBy("at_ns").select("arrival", "kind", "disposition", "attempt", "session_id", "at_ns").collect()]
    assert got == [
        (1, "ack", "ack", False, 0, 1 * second), (2, "snapshot", "accepted_snapshot", False, 0, 2 * second),
        (3, "update", "published", False, 0, 3 * second), (2, "update", "late", False, 0, 5 * second),
        (3, "timeout", "timeout", True, 1, 61 * second),
    ]


def test_lagging_instrument_loses_nothing_and_late_rows_agree(spark):
    """An instrument far behind the others, in its own order, and rows behind their own stream, in both forms."""
    second = 10**9
    rows = [(1, i, "snapshot" if i == 1 else "update", 1000 * second + i) for i in range(1, 6)]
    rows += [(2, 1, "snapshot", 400 * second), (2, 2, "update", 401 * second)]
    rows += [(1, 3, "update", 1), (1, 11, "update", 1011 * second), (1, 5, "snapshot", 2), (2, 3, "update", 402 * second)]
    keyed, folded = fresh_path(spark, "out"), fresh_path(spark, "out")
    stream = keyed_sessions(layout(spark, rows, 4), timeout_ns=3600 * second)
    start_keyed(stream, write_once(keyed), fresh_path(spark, "ckpt"), once=True).awaitTermination()
    step = fold_batches(spark, fresh_path(spark, "state"), write_once(folded), Lane(width=16))
    start_keyed(layout(spark, rows, 4), step, fresh_path(spark, "ckpt"), once=True).awaitTermination()
    names = ("instrument_id", "arrival", "kind", "disposition", "open_after", "session_id", "gateway_seq")
    got = [sorted((tuple(r) for r in spark.read.parquet(p).select(*names).collect()), key=repr) for p in (keyed, folded)]
    assert got[0] == got[1]
    assert len(got[0]) == len(rows)
    assert sum(r[3] == "late" for r in got[0]) == 2
    assert [r[6] for r in got[0] if r[0] == 2] == [1, 2, 3]


def test_two_venues_do_not_share_a_gate(spark):
    rows = [(v, 7, i, k, i) for v in (1, 2) for i, k in enumerate(("snapshot", "update") if v == 1 else ("update", "snapshot"), 1)]
    schema = "venue int, instrument_id bigint, arrival bigint, kind string, at_ns bigint"
    path = fresh_path(spark, "venues")
    spark.createDataFrame(rows, schema).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    keys = ("venue", "instrument_id")
    keyed, folded = fresh_path(spark, "out"), fresh_path(spark, "out")
    start_keyed(keyed_sessions(stream, keys=keys), write_once(keyed), fresh_path(spark, "ckpt"), once=True).awaitTermination()
    step = fold_batches(spark, fresh_path(spark, "state"), write_once(folded), Lane(keys=keys))
    start_keyed(stream, step, fresh_path(spark, "ckpt"), once=True).awaitTermination()
    for out in (keyed, folded):
        got = {(r.venue, r.arrival): r.disposition for r in spark.read.parquet(out).collect()}
        assert got == {(1, 1): "accepted_snapshot", (1, 2): "published", (2, 1): "pre_snapshot", (2, 2): "accepted_snapshot"}


def test_messages_are_stored_once_however_batches_are_cut(spark):
    messages = [(k, s, n) for k in (1, 2) for s in range(3) for n in range(4 + k)]
    frame = lambda rows: spark.createDataFrame(rows, "instrument_id bigint, session_id bigint, gateway_seq bigint")
    path = fresh_path(spark, "identity")
    first = write_messages(path)
    halves = [[m for m in messages if m[1] < 1], [m for m in messages if m[1] == 1]]
    for n, rows in enumerate(halves):
        first(frame([*rows, *rows[:2]]), n)
        first(frame(rows), n)  # the same batch again
    # Another writer starts from the beginning: other borders, batch numbers from 0.
    second, cut = write_messages(path), 7
    ordered = sorted(messages, key=lambda m: m[1:])
    for n in range(0, len(ordered), cut):
        second(frame(ordered[n : n + cut]), n // cut)
    assert sorted(tuple(r) for r in read_messages(spark, path).collect()) == sorted(messages)


def test_a_commit_without_marks_is_not_seen(spark):
    path = fresh_path(spark, "identity")
    frame = spark.createDataFrame([(1, 0, 1)], "instrument_id bigint, session_id bigint, gateway_seq bigint")
    write_messages(path)(frame, 0)
    frame.withColumn("gateway_seq", F.lit(9).cast("bigint")).write.parquet(f"{path}/data/commit=1")  # a writer that died
    assert [r.gateway_seq for r in read_messages(spark, path).collect()] == [1]
    write_messages(path)(frame.withColumn("gateway_seq", F.lit(2).cast("bigint")), 1)
    assert sorted(r.gateway_seq for r in read_messages(spark, path).collect()) == [1, 2]


def fired(spark, out):
    try:
        rows = spark.read.parquet(out).where("kind = 'timeout'").orderBy("at_ns").collect()
    except Exception:  # nothing is written yet
        return []
    return [(r.instrument_id, r.attempt, r.at_ns) for r in rows]


def test_a_silent_key_fires_by_its_timer_before_and_after_a_restart(spark):
    """No row of the key comes after the first batch: the registered timers alone close its silence, and again while
    ignored. After a restart they wait for the first row of any key."""
    second = 10**9
    path, out, checkpoint = (fresh_path(spark, n) for n in ("silent", "out", "ckpt"))
    schema = "instrument_id bigint, arrival bigint, kind string, at_ns bigint"
    rows = [(1, 1, "ack", 1 * second), (1, 2, "snapshot", 2 * second), (2, 1, "snapshot", 2 * second)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)

    def start(name):
        stream = keyed_sessions(spark.readStream.schema(schema).parquet(path), timeout_ns=2 * second, restart=True, live=True)
        return start_keyed(stream, write_once(f"{out}/{name}"), checkpoint)

    def wait(name, n):
        until = time.time() + 90
        while len(fired(spark, f"{out}/{name}")) < n and time.time() < until:
            time.sleep(0.5)

    query = start("first")
    wait("first", 1)
    query.stop()
    before = fired(spark, f"{out}/first")
    query = start("second")
    spark.createDataFrame([(2, 2, "update", 3 * second)], schema).coalesce(1).write.mode("append").parquet(path)
    wait("second", 2)
    query.stop()
    after = fired(spark, f"{out}/second")
    # The clock starts at the acknowledgement (1 s); the first timeout resets and the clock starts anew, later ones are ignored.
    assert before[0] == (1, True, 3 * second) and not any(attempt for _, attempt, _ in before[1:])
    times = [at for _, _, at in [*before, *after]]
    assert len(after) >= 2 and not any(attempt for _, attempt, _ in after)
    assert times == [3 * second + i * 2 * second for i in range(len(times))]
    assert {key for key, _, _ in [*before, *after]} == {1}


def test_order_feed_stream_equals_the_fold(spark):
    """Deltas wait in the state across micro-batches; documents release them."""
    from test_session_feed import SCHEMA as FEED
    from test_session_feed import stream

    rows = stream(21, sizes=(160, 60, 9))
    path, out = fresh_path(spark, "feed"), fresh_path(spark, "messages")
    for low in range(0, 161, 40):
        part = [r for r in rows if low < r[1] <= low + 40]
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(path)
    # Late rows: behind their stream, nothing changes.
    spark.createDataFrame([r for r in rows if r[1] % 10 == 0], FEED).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(path)
    rules = FeedRules(True, 200, True, slots=6)
    start_keyed(feed_messages(source, rules), write_messages(out), fresh_path(spark, "ckpt"), once=True).awaitTermination()
    got = sorted((r.instrument_id, r.session_id, r.gateway_seq, r.arrival) for r in read_messages(spark, out).collect())
    want = []
    for key in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == key]
        fold = FeedFold(6, 200).run(mine, mine[-1][2])
        want += [(key, session, 0, pos) for pos, session, _, _, applied in fold.asked if applied]
        want += [(key, session, number, pos) for pos, (session, _, number) in fold.labels.items() if number]
    assert got == sorted(want)


def test_a_million_rows_of_one_key_stay_packed():
    """Rows come in chunks, out of order; slices are told in order and nothing else is held but packed columns."""
    n, size = 1_000_000, 10_000
    order = [(i * 7919) % n for i in range(n)]

    def chunks():
        for low in range(0, n, size):
            part = order[low : low + size]
            yield pd.DataFrame({"arrival": part, "kind": ["update" if p % 3 else "heartbeat" for p in part], "at_ns": [p * 5 for p in part]})

    import tracemalloc

    tracemalloc.start()
    expected = 0
    for part in in_order(chunks(), ["at_ns"]):
        rows = list(part)
        assert len(rows) <= 1 << 13
        for arrival, kind, at_ns in rows:
            assert (arrival, kind, at_ns) == (expected, "update" if expected % 3 else "heartbeat", expected * 5)
            expected += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert expected == n and peak < 70_000_000


def test_books_in_the_stream(spark):
    """Orders over several micro-batches from books of a batch table; resets and documents empty them."""
    rng, rows = random.Random(31), []
    start = {(1, 3): ("open", 50), (1, 4): ("change", 9), (2, 3): ("open", 1)}
    want = {k: dict(v for v in [(ref, state) for (key, ref), state in start.items() if key == k]) for k in (1, 2, 3)}
    for pos in range(11, 211):
        for key in (1, 2, 3):
            kind = rng.choices(["open", "change", "done", "match", "received", "reset", "document"], [6, 2, 3, 4, 2, 0.2, 0.2])[0]
            ref, qty = rng.randint(0, 9), rng.randint(1, 30)
            rows.append((key, pos, kind, ref, qty))
            book = want[key]
            if kind in ("reset", "document"):
                book.clear()
            elif kind in ("open", "change"):
                book[ref] = (kind, qty)
            elif kind == "done":
                book.pop(ref, None)
            elif kind == "match" and ref in book:
                book[ref] = (book[ref][0], book[ref][1] - qty)
    path, out = fresh_path(spark, "orders"), fresh_path(spark, "books")
    schema = "instrument_id bigint, arrival bigint, kind string, order_ref bigint, qty bigint"
    for low in range(11, 211, 67):
        spark.createDataFrame([r for r in rows if low <= r[1] < low + 67], schema).coalesce(1).write.mode("append").parquet(path)
    initial = spark.createDataFrame([(k, ref, *state, 10) for (k, ref), state in start.items()], "instrument_id bigint, order_ref bigint, kind string, resting bigint, last_arrival bigint")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    start_keyed(stream_orders(source, initial=initial), write_once(out), fresh_path(spark, "ckpt"), once=True).awaitTermination()
    changes = spark.read.parquet(out).drop("batch")
    told = initial.selectExpr("instrument_id", "order_ref", "kind as last_kind", "resting", "last_arrival as version")
    got = {(r.instrument_id, r.order_ref): (r.last_kind, r.resting) for r in latest_orders(told.unionByName(changes), "instrument_id").collect()}
    assert got == {(k, ref): state for k, book in want.items() for ref, state in book.items()}


def test_the_carried_state_is_not_repeated_per_salt(spark):
    rows = spark.createDataFrame([(1, 5, "snapshot"), (1, 2, "update")], "instrument_id bigint, arrival bigint, kind string")
    state = spark.createDataFrame([(1, 3, False, True, 2, 4)], "instrument_id bigint, last_arrival bigint, is_open boolean, recovering boolean, session bigint, seq bigint")
    told, after = resume_session_rules(rows, state)
    assert {r["arrival"]: (r["disposition"], r["session_id"], r["gateway_seq"]) for r in told.collect()} == {5: ("accepted_snapshot", 2, 5), 2: ("late", 2, None)}
    assert tuple(after.select("last_arrival", "is_open", "recovering", "session", "seq").first()) == (5, True, False, 2, 5)
    for df in (told, after):
        assert "_salt" not in df._jdf.queryExecution().optimizedPlan().toString()
