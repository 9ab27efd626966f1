"""Frame, encode, recovery, latency and connection accounting as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.wirecodes import encoded_size
from feedlake.operators.ordering import Lane, max_before, max_upto, running


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def frame_accounting() -> dict[str, Column]:
    """Counter columns over rows with ``kind``, ``disposition`` and ``payload``.

    A rejected message over the entry cap is an encode failure, every other reject a parse failure.
    """
    done, over = F.col("disposition"), F.coalesce(F.col("over_cap"), F.lit(False))
    accepted, published = done == "accepted_snapshot", done == "published"
    malformed = (done == "malformed") | ((done == "rejected") & ~over)
    return {
        "frames_received": F.count("*"),
        "bytes_received": F.sum("frame_bytes"),
        "messages_decoded": count_if(accepted | published | done.isin("heartbeat", "ack", "error")),
        "snapshot_messages_received": count_if(accepted),
        "update_messages_received": count_if(published),
        "heartbeats_received": count_if(done == "heartbeat"),
        "parse_failures": count_if(malformed),
        "malformed_rejections": count_if(malformed),
        "authentication_errors": count_if(done == "error"),
        "unknown_type_drops": count_if(done == "unknown"),
        "pre_snapshot_drops": count_if(done == "pre_snapshot"),
        "unknown_symbol_drops": count_if(done == "mismatch"),
        "product_id_mismatches": count_if(done == "mismatch"),
        "subscription_validation_failures": count_if(done == "trigger"),
    }


def encode_accounting(template: Column) -> dict[str, Column]:
    """Encode counters; ``template`` is the message template of each row."""
    sent = F.coalesce(F.col("publishable"), F.lit(False))
    over = F.coalesce(F.col("over_cap"), F.lit(False)) & (F.col("disposition") == "rejected")
    return {
        "encode_successes": count_if(sent),
        "encode_failures": count_if(over),
        "levels_encoded": F.coalesce(F.sum(F.when(sent, F.col("entry_count"))), F.lit(0)).cast("bigint"),
        "encoded_bytes": F.coalesce(
            F.sum(F.when(sent, encoded_size(template, F.col("entry_count")))), F.lit(0)
        ),
    }


def recovery_accounting() -> dict[str, Column]:
    """Recovery counters over rows of the session rules.

    Every attempt executes; it completes when a snapshot is accepted before it is recorded as failed.
    """
    return {
        "recovery_attempts": count_if(F.col("attempt")),
        "recovery_executions": count_if(F.col("attempt")),
        "recovery_completions": count_if((F.col("disposition") == "accepted_snapshot") & F.col("recovering")),
        "recovery_failures": count_if(F.col("kind") == "recovery_failed"),
        "recovery_requests_ignored_in_progress": count_if(F.col("ignored")),
    }


def aggregate(rows: DataFrame, counters: dict[str, Column], *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in counters.items()])


def latency_summary(samples: DataFrame, lane: Lane, value: str = "latency") -> DataFrame:
    """Per key a struct ``latency``: whether a ``zero`` occurred, the ``low`` since the last one, ``high`` and ``last``."""
    keys, pos, lat = lane.keys, F.col(lane.pos), F.col(value)
    sweep = running(samples, lane, _zero=max_upto(F.when(lat == 0, pos)))
    # Rows after the last zero are those whose last zero so far equals the key's last zero overall,
    # so one map-side aggregate per (key, last zero so far) is enough; its newest group wins.
    per_zero = sweep.groupBy(*keys, "_zero").agg(
        F.min(F.when(lat != 0, lat)).alias("low"), F.max(lat).alias("high"), F.max(F.struct(pos, lat)).alias("tail")
    )
    return per_zero.groupBy(*keys).agg(
        F.struct(
            F.max("_zero").isNotNull().alias("zero"),
            F.max_by("low", F.coalesce("_zero", F.lit(-1))).alias("low"),
            F.max("high").alias("high"),
            F.max("tail")[value].alias("last"),
        ).alias("latency")
    )


def latency_columns() -> list[Column]:
    """Minimum, maximum and last from the struct of :func:`latency_summary`."""
    return [
        F.coalesce("latency.low", F.lit(0)).alias("latency_min"),
        F.col("latency.high").alias("latency_max"),
        F.col("latency.last").alias("latency_last"),
    ]


def latency_stats(samples: DataFrame, lane: Lane, value: str = "latency") -> DataFrame:
    """Minimum, maximum and last latency per key.

    A stored minimum of 0 reads as "unset", so a zero sample is overwritten by the next one: the
    minimum runs over the samples after the last zero, or is 0 when a zero came last.
    """
    return latency_summary(samples, lane, value).select(*lane.keys, *latency_columns())


def connection_accounting(events: DataFrame, *keys: str) -> DataFrame:
    """Connection counters over rows with ``event`` in attempt/success/failure/reconnect."""
    event = F.col("event")
    return events.groupBy(*keys).agg(
        count_if(event == "attempt").alias("connection_attempts"),
        count_if(event == "success").alias("connection_successes"),
        count_if(event == "failure").alias("connection_failures"),
        count_if(event == "reconnect").alias("reconnect_attempts"),
    )


def connection_summary(edges: DataFrame, lane: Lane, opened: Column, closed: Column) -> DataFrame:
    """Per key a struct ``edges``: the ``first`` and ``last`` state (1 open), and the changes after the first edge."""
    state = F.when(opened, 1).when(closed, 0)
    traced = running(
        edges.withColumn("_state", state).where(F.col("_state").isNotNull()),
        lane,
        _last=max_before(F.struct(F.col(lane.pos), F.col("_state").alias("state"))),
    )
    changed = F.col("_state") != F.col("_last.state")
    return traced.groupBy(*lane.keys).agg(
        F.struct(
            F.max(F.when(F.col("_last").isNull(), F.col("_state"))).alias("first"),
            F.max_by("_state", F.col(lane.pos)).alias("last"),
            count_if(changed & (F.col("_state") == 1)).alias("opens"),
            count_if(changed & (F.col("_state") == 0)).alias("closes"),
        ).alias("edges")
    )


def connection_columns() -> list[Column]:
    """Counters from the struct of :func:`connection_summary`; a connection starts closed."""
    opens = F.col("edges.opens") + F.col("edges.first")
    return [
        opens.alias("opens"),
        F.col("edges.closes").alias("closes"),
        (opens - F.col("edges.closes")).cast("bigint").alias("active_connections"),
    ]


def active_connections(edges: DataFrame, lane: Lane, opened: Column, closed: Column) -> DataFrame:
    """Connections open now and at most, per key; an edge that repeats the current state does not count.

    The state before a row is the newest earlier edge, so one running maximum tells real changes
    apart; the gauge of all keys together is the sum of the results.
    """
    return connection_summary(edges, lane, opened, closed).select(*lane.keys, *connection_columns())


def error_groups(errors: DataFrame, *keys: str, at: str = "ts") -> DataFrame:
    """Identical errors once: how often, first seen, last seen."""
    return errors.groupBy(*keys).agg(
        F.count("*").alias("occurrences"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen")
    )
