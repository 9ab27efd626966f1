"""Streaming queries over V1, driven to completion; their oracles are the batch results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedlake.functions import ntz_nanos
from feedlake.operators import counters
from feedlake.operators.l2 import classify_l2
from feedlake.operators.ordering import Lane, dense_arrival
from feedlake.operators.session_feed import feed_events, session_feed
from feedlake.plans import merged_feed
from feedlake.plans.books import FAMILY as FAMILY_OF_BOOKS
from feedlake.plans.books import TIMEOUT, _liveness_sql
from feedlake.plans.level_feed import A1_SQL, A2_SQL, A3_SQL, A7_SQL
from feedlake.plans.oracle import L2_RULES
from feedlake.plans.registration import Family
from feedlake.plans.views import FEED_ORDER, L2_PAYLOAD, l2_frames, spark_text, table
from feedlake.session import fresh_path, stored
from feedlake.sources.metrics import counter_labels, to_prometheus
from feedlake.streaming import (
    accumulate,
    each,
    feed_messages,
    fold_batches,
    keyed_sessions,
    latest_orders,
    read_messages,
    read_totals,
    start_keyed,
    stream_orders,
    write_messages,
    write_once,
)
from feedlake.streaming.accounting import earliest, edges_merged, latest
from feedlake.venues import FEEDS

FAMILY = Family()
register = FAMILY.register

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def classified_stream(spark, source: str, *keep: str):
    """V1 as a stream. Event ids grow with time, so they serve as the arrival position."""
    frames = (
        spark.readStream.schema(_EVENTS)
        .option("maxFilesPerTrigger", 1_000_000)
        .parquet(source)
        .select(
            F.col("user_id").cast("bigint").alias("instrument_id"),
            F.col("event_id").alias("arrival"),
            F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("symbol"),
            F.expr(spark_text(L2_PAYLOAD)).alias("payload"),
            ntz_nanos(F.col("ts")).alias("at_ns"),
            "event_type",
            "props",
        )
    )
    told = classify_l2(frames.withColumn("frame_bytes", F.octet_length("payload")))
    is_tick = F.col("event_type") == "tick"
    return told.select(
        "instrument_id",
        "arrival",
        F.when(is_tick, F.lit("tick")).otherwise(F.col("kind")).alias("kind"),
        F.when(is_tick, F.col("props").cast("bigint")).otherwise(F.col("at_ns")).alias("at_ns"),
        *keep,
    )


def run_in_pieces(spark, sf_dir, start, pieces: int = 3, ticks: str | None = None, keep: tuple[str, ...] = ()):
    """Append the events piece by piece, in order, and drain the stream after each piece.

    Every drain is a new query on the same checkpoint, so this also exercises restarts. ``ticks`` is a
    folder of rows (instrument_id, kind, at_ns) that come with the last piece.
    """
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    width = (high - low) // pieces + 1
    source = fresh_path(spark, "frames")
    for piece in range(pieces):
        first = low + piece * width
        events.where(F.col("event_id").between(first, first + width - 1)).write.mode("append").parquet(source)
        if ticks and piece == pieces - 1:
            clock = spark.read.parquet(ticks)
            rows = clock.select(
                F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"),
                F.col("instrument_id").alias("user_id"), F.col("kind").alias("event_type"),
                F.lit(None).cast("double").alias("value"), F.col("at_ns").cast("string").alias("props"),
            )
            rows.write.mode("append").parquet(source)
        start(classified_stream(spark, source, *keep)).awaitTermination()


_ROWS_SQL = f"""with {L2_RULES} select instrument_id, event_id as arrival, kind, disposition, attempt = 1 as attempt, ignored = 1 as ignored,
  session_id, gateway_seq from r"""
_ROWS = ("instrument_id", "arrival", "kind", "disposition", "attempt", "ignored", "session_id", "gateway_seq")


@register("t1_keyed_sessions", _ROWS_SQL)
def t1_keyed_sessions(spark, sf_dir):
    """Keyed state over several micro-batches equals the batch fold."""
    out = fresh_path(spark, "sessions")
    checkpoint = fresh_path(spark, "checkpoint")
    run_in_pieces(
        spark, sf_dir, lambda stream: start_keyed(keyed_sessions(stream), write_once(out), checkpoint, once=True)
    )
    return spark.read.parquet(out).select(*_ROWS)


@register("t5_folded_sessions", _ROWS_SQL)
def t5_folded_sessions(spark, sf_dir):
    """Bucketed folds per micro-batch with a carried state table, written by an idempotent sink."""
    out = fresh_path(spark, "folded")
    step = fold_batches(spark, fresh_path(spark, "state"), write_once(out))
    checkpoint = fresh_path(spark, "checkpoint")

    def start(stream):
        return start_keyed(stream.select("instrument_id", "arrival", "kind"), step, checkpoint, once=True)

    run_in_pieces(spark, sf_dir, start)
    return spark.read.parquet(out).select(*_ROWS)


def _accounting(spark, sf_dir, *sinks):
    """V1 through the bucketed folds, each micro-batch with its outcomes given to ``sinks``."""
    step = fold_batches(spark, fresh_path(spark, "state"), each(*sinks))
    checkpoint = fresh_path(spark, "checkpoint")
    run_in_pieces(
        spark, sf_dir, lambda stream: start_keyed(stream, step, checkpoint, once=True), keep=("frame_bytes", "over_cap", "entry_count")
    )


def _gauges() -> dict:
    """A4: the newest message, and the newest heartbeat or acknowledgement (0 without one)."""
    heard = F.when(F.col("kind").isin("heartbeat", "ack"), F.col("at_ns"))
    return {
        "last_message_received_nanos": F.max("at_ns"),
        "last_heartbeat_received_nanos": F.coalesce(F.max(heard), F.lit(0)),
    }


_PREFIXES = f"""{L2_RULES}, cuts as (select min(event_id) as low, (max(event_id) - min(event_id)) // 3 + 1 as width from events),
p as (select b.batch, r.* from r, cuts, (select cast(unnest([0, 1, 2]) as integer) as batch) b where event_id < low + (b.batch + 1) * width)"""


@register(
    "s7_stream_metrics",
    f"""with {_PREFIXES}, a as (select batch, instrument_id, {A1_SQL}, {A2_SQL}, {A3_SQL},
  max(epoch_us(ts)) * 1000 as last_message_received_nanos,
  coalesce(max(case when kind in ('heartbeat', 'ack') then epoch_us(ts) end) * 1000, 0) as last_heartbeat_received_nanos
  from p group by batch, instrument_id),
u as (unpivot a on columns(* exclude (batch, instrument_id)) into name name value value)
select batch, concat('gateway_', name, '{{instance_id="i-1",environment="test",venue="L2",instrument_id="', cast(instrument_id as varchar), '"}} ', cast(value as varchar)) as line from u""",
)
def s7_stream_metrics(spark, sf_dir):
    """A1 to A4 and S7 as a stream: the metric lines after every micro-batch are those of all rows so far."""
    lines, totals = fresh_path(spark, "lines"), fresh_path(spark, "totals")
    write = write_once(lines)
    columns = {
        **counters.frame_accounting(),
        **counters.encode_accounting(F.lit(1)),
        **counters.recovery_accounting(),
        **_gauges(),
    }

    def publish(wide, batch_id):
        write(to_prometheus(counter_labels(wide, "i-1", "test", "L2")), batch_id)

    def summary(rows):
        return counters.aggregate(rows, columns, "instrument_id")

    gauges = dict.fromkeys(_gauges(), latest)
    _accounting(spark, sf_dir, accumulate(totals, ["instrument_id"], summary, gauges, publish))
    return spark.read.parquet(lines).select("batch", "line")


@register("a7_stream_error_groups", A7_SQL)
def a7_stream_error_groups(spark, sf_dir):
    """Errors grouped over three micro-batches: occurrences add up, first and last seen are kept."""
    totals = fresh_path(spark, "errors")

    def summary(rows):
        errors = rows.where(F.col("disposition").isin("rejected", "mismatch", "trigger", "duplicate_snapshot"))
        timed = errors.select("instrument_id", F.col("disposition").alias("error"), F.col("at_ns").alias("ts"))
        return counters.error_groups(timed, "instrument_id", "error")

    bounds = {"first_seen": earliest, "last_seen": latest}
    _accounting(spark, sf_dir, accumulate(totals, ["instrument_id", "error"], summary, bounds))
    return read_totals(spark, totals)


@register("a6_stream_connections", FAMILY_OF_BOOKS.sql["a6_connections"])
def a6_stream_connections(spark, sf_dir):
    """Connection edges over three micro-batches: an edge that repeats the state another batch left does not count."""
    totals, checkpoint = fresh_path(spark, "edges"), fresh_path(spark, "checkpoint")
    kind = F.col("event_type")

    def summary(rows):
        return counters.connection_summary(rows, Lane(), kind == "signup", kind == "error")

    step = accumulate(totals, ["instrument_id"], summary, {"edges": edges_merged})

    def start(stream):
        return start_keyed(stream.select("instrument_id", "arrival", "event_type"), step, checkpoint, once=True)

    run_in_pieces(spark, sf_dir, start, keep=("event_type",))
    return read_totals(spark, totals).select("instrument_id", *counters.connection_columns())


@register(
    "t5_identity_sink",
    f"""with {L2_RULES} select instrument_id, session_id, coalesce(gateway_seq, 0) as gateway_seq, event_id as arrival, kind
from r where pub = 1 or attempt = 1""",
)
def t5_identity_sink(spark, sf_dir):
    """The stream runs twice, the second time without its checkpoint and in other pieces: every message is stored once."""
    out = fresh_path(spark, "messages")
    sink = write_messages(out)

    def publish(batch, batch_id):
        sent = batch.where("attempt or gateway_seq is not null")
        number = F.coalesce("gateway_seq", F.lit(0)).cast("bigint").alias("gateway_seq")
        sink(sent.select("instrument_id", "session_id", number, "arrival", "kind"), batch_id)

    for pieces in (3, 2):
        checkpoint = fresh_path(spark, "checkpoint")

        def start(stream, checkpoint=checkpoint):
            return start_keyed(keyed_sessions(stream), publish, checkpoint, once=True)

        run_in_pieces(spark, sf_dir, start, pieces)
    return read_messages(spark, out)


@register(
    "t2_liveness_timers",
    f"select instrument_id, fired_ns as at_ns, applied from ({_liveness_sql(TIMEOUT)}) fired",
)
def t2_liveness_timers(spark, sf_dir):
    """Twelve-hour timeouts from every instrument's own clock; ticks at the end of the data close the silences."""
    out = fresh_path(spark, "liveness")
    checkpoint = fresh_path(spark, "checkpoint")
    events = table(spark, sf_dir, "events")
    horizon = events.agg(F.max(ntz_nanos(F.col("ts")))).first()[0] + 1
    ends = events.select(F.col("user_id").cast("bigint").alias("instrument_id")).distinct()
    ticks = fresh_path(spark, "ticks")
    ends.withColumns({"kind": F.lit("tick"), "at_ns": F.lit(horizon)}).write.parquet(ticks)

    def start(stream):
        return start_keyed(keyed_sessions(stream, timeout_ns=TIMEOUT), write_once(out), checkpoint, once=True)

    run_in_pieces(spark, sf_dir, start, ticks=ticks)
    fired = spark.read.parquet(out).where("kind = 'timeout'")
    return fired.select("instrument_id", "at_ns", F.col("attempt").alias("applied"))


@register(
    "u1_registered_feed",
    f"""with {L2_RULES} select instrument_id, kind, count(*) as n from r group by instrument_id, kind""",
)
def u1_registered_feed(spark, sf_dir):
    """Frames through the feed that the registry names."""
    feed = FEEDS["COINBASE_L2"]
    return feed.classify(l2_frames(spark, sf_dir)).groupBy("instrument_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@register(
    "u2_sink_callable",
    f"""with {L2_RULES} select disposition, count(*) as n, cast(sum(pub) as bigint) as published from r group by disposition""",
)
def u2_sink_callable(spark, sf_dir):
    """A publisher of one's own: any callable takes the batches; this one stores counts per outcome."""
    out, checkpoint = fresh_path(spark, "published"), fresh_path(spark, "checkpoint")

    def publish(batch, batch_id):
        counts = batch.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), F.count("gateway_seq").alias("published"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_in_pieces(spark, sf_dir, lambda stream: start_keyed(keyed_sessions(stream), publish, checkpoint, once=True), pieces=2)
    return spark.read.parquet(out).groupBy("disposition").agg(F.sum("n").alias("n"), F.sum("published").alias("published"))


# Instruments lag by up to a day each and every tenth row comes again: its own stream has passed it then.
_LATE_SQL = f"""with {L2_RULES}, told as (
  select instrument_id, event_id as arrival, disposition, session_id, gateway_seq from r
  union all
  select instrument_id, event_id, 'late', null, null from r where event_id % 10 = 0)
select instrument_id, disposition, count(*) as n, count(gateway_seq) as published from told group by all"""


def _lagging(spark, sf_dir, start):
    """Three pieces by instrument and time, so that instruments run far ahead of each other; the last piece
    repeats old rows of all of them."""
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    width = (high - low) // 3 + 1
    piece = F.expr(f"(event_id - {low}) div {width}")
    source = fresh_path(spark, "lagging")
    # Even instruments are complete before odd ones begin; then everything that comes again.
    parts = [
        events.where("user_id % 2 = 0"),
        events.where("user_id % 2 = 1").where(piece < 2),
        events.where("user_id % 2 = 1").where(piece >= 2),
        events.where("event_id % 10 = 0"),
    ]
    for part in parts:
        part.repartition(3).write.mode("append").parquet(source)
        start(classified_stream(spark, source)).awaitTermination()


def _outcomes(rows):
    return rows.groupBy("instrument_id", "disposition").agg(
        F.count(F.lit(1)).alias("n"), F.count("gateway_seq").alias("published")
    )


@register("t3_late_rows", _LATE_SQL)
def t3_late_rows(spark, sf_dir):
    """No row of a lagging instrument is lost; repeated rows are counted as late. Keyed form, with liveness
    switched on but a timeout beyond the data."""
    out, checkpoint = fresh_path(spark, "late"), fresh_path(spark, "checkpoint")
    forever = 10**18
    _lagging(
        spark, sf_dir, lambda stream: start_keyed(keyed_sessions(stream, timeout_ns=forever), write_once(out), checkpoint, once=True)
    )
    return _outcomes(spark.read.parquet(out))


@register("t3_late_rows_folded", _LATE_SQL)
def t3_late_rows_folded(spark, sf_dir):
    """The same by bucketed folds."""
    out, checkpoint = fresh_path(spark, "late"), fresh_path(spark, "checkpoint")
    step = fold_batches(spark, fresh_path(spark, "state"), write_once(out))

    def start(stream):
        return start_keyed(stream.select("instrument_id", "arrival", "kind"), step, checkpoint, once=True)

    _lagging(spark, sf_dir, start)
    return _outcomes(spark.read.parquet(out))


@register("l3_stream_messages", merged_feed.FAMILY.sql["l3_session_messages"])
def l3_stream_messages(spark, sf_dir):
    """Alignment, sessions and recovery of the merged feed as keyed state, over four micro-batches and two restarts:
    the messages of the batch form (J4, W6, W7, W12)."""
    feed = merged_feed.merged_feed(spark, sf_dir)
    width = feed.agg(F.max("arrival")).first()[0] // 4 + 1
    staged, source = fresh_path(spark, "staged"), fresh_path(spark, "feed")
    feed.withColumn("piece", F.expr(f"arrival div {width}")).write.partitionBy("piece").parquet(staged)
    out, checkpoint = fresh_path(spark, "messages"), fresh_path(spark, "checkpoint")
    schema = "instrument_id bigint, arrival bigint, event_id bigint, at_ns bigint, kind string, seq bigint"
    for piece in range(4):
        spark.read.schema(schema).parquet(f"{staged}/piece={piece}").write.mode("append").parquet(source)
        if piece != 1:  # the second piece comes together with the third
            stream = feed_messages(spark.readStream.schema(schema).parquet(source), merged_feed.RULES)
            start_keyed(stream, write_messages(out), checkpoint, once=True).awaitTermination()
    return read_messages(spark, out).drop("cause")


def _order_messages(spark, sf_dir):
    """What a consumer of the merged feed sees of orders, in message order: resets, documents with their orders, deltas."""
    feed = stored(merged_feed.merged_feed(spark, sf_dir), "merged")
    events = feed_events(feed, merged_feed.RULES)
    sent = stored(session_feed(feed, events).where("gateway_seq is not null"), "sent")
    nothing = F.lit(None).cast("bigint")
    resets = events.where("applied").select(
        "instrument_id", "session_id", F.lit(0).cast("bigint").alias("gateway_seq"), F.lit(0).cast("bigint").alias("entry"),
        F.lit("reset").alias("kind"), nothing.alias("order_ref"), nothing.alias("qty"),
    )
    documents = sent.where("kind = 'snapshot'")
    heads = documents.select(
        "instrument_id", "session_id", "gateway_seq", F.lit(0).cast("bigint").alias("entry"), F.lit("document").alias("kind"),
        nothing.alias("order_ref"), nothing.alias("qty"),
    )
    entry = F.row_number().over(Window.partitionBy("instrument_id", "arrival").orderBy("order_ref"))
    images = merged_feed.images(spark, sf_dir).withColumn("entry", entry.cast("bigint"))
    listed = documents.select("instrument_id", "arrival", "session_id", "gateway_seq").join(images, ["instrument_id", "arrival"])
    listed = listed.select("instrument_id", "session_id", "gateway_seq", "entry", F.lit("open").alias("kind"), "order_ref", (F.col("qty") * 100).cast("bigint").alias("qty"))
    deltas = sent.where("kind <> 'snapshot'").select(
        "instrument_id", "session_id", "gateway_seq", F.lit(0).cast("bigint").alias("entry"), F.expr(FEED_ORDER).alias("kind"),
        (F.col("event_id") % 9).alias("order_ref"), ((F.col("event_id") % 40 + 1) * 100).cast("bigint").alias("qty"),
    )
    every = resets.unionByName(heads).unionByName(listed).unionByName(deltas)
    return dense_arrival(stored(every, "order-messages"), ["instrument_id"], ["session_id", "gateway_seq", "entry"])


@register("b2_stream_orders", merged_feed.FAMILY.sql["b2_session_orders"])
def b2_stream_orders(spark, sf_dir):
    """Resting orders kept as keyed state over three micro-batches and restarts equal those of the batch form."""
    staged, source = fresh_path(spark, "staged"), fresh_path(spark, "orders")
    rows = _order_messages(spark, sf_dir)
    rows.withColumn("piece", F.least(F.expr("arrival div 12"), F.lit(2))).write.partitionBy("piece").parquet(staged)
    schema = "instrument_id bigint, session_id bigint, gateway_seq bigint, entry bigint, kind string, order_ref bigint, qty bigint, arrival bigint"
    out, checkpoint = fresh_path(spark, "books"), fresh_path(spark, "checkpoint")
    for piece in range(3):
        spark.read.schema(schema).parquet(f"{staged}/piece={piece}").write.mode("append").parquet(source)
        stream = stream_orders(spark.readStream.schema(schema).parquet(source))
        start_keyed(stream, write_once(out), checkpoint, once=True).awaitTermination()
    book = latest_orders(spark.read.parquet(out).drop("batch"), "instrument_id")
    return book.select("instrument_id", "order_ref", "last_kind", (F.col("resting") / 100).cast("decimal(18,2)").alias("resting_qty"))
