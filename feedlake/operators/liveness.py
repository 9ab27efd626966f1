"""Heartbeat liveness: silences that a periodic check would have reported.

Monitoring and recovery depend on each other: a timeout asks for recovery, an applied recovery closes the
connection and with it the monitoring, and an ignored request leaves the check running. So both are folded
together, by the machine of :mod:`feedlake.operators.session_feed`; :class:`Monitor` is the same clock for streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.operators.ordering import Lane
from feedlake.operators.session_feed import FeedRules, feed_events


class Monitor:
    """Check grid of one instrument.

    ``restart`` is the order feed: monitoring starts with the subscription, here the first signal, and an
    applied recovery subscribes again at once. ``start`` and ``last`` are None while unset.
    """

    def __init__(self, timeout: int, restart: bool = False):
        self.timeout, self.restart = timeout, restart
        self.start = self.last = None

    def check(self) -> int | None:
        """The first check that finds the last signal a timeout old: ``timeout`` after the start, then every
        half timeout."""
        if self.start is None or self.last is None:
            return None
        half = self.timeout // 2
        return self.start + self.timeout + max(0, -(-(self.last - self.start) // half)) * half

    def fire(self, limit: int) -> tuple[int, int] | None:
        """(time, last signal) of the next timeout before ``limit``. The clock starts again at the timeout."""
        at = self.check()
        if at is None or at >= limit:
            return None
        since, self.last = self.last, at
        return at, since


def liveness_timeouts(
    frames: DataFrame, timeout: int, horizon_ns, lane: Lane = Lane(), at: str = "at_ns", restart: bool = False
) -> DataFrame:
    """Timeouts ``(keys, fired_ns, since_ns, applied)`` of classified frames in stream order.

    Checks happen ``timeout`` after the start and then every half timeout; one that finds the last signal
    at least a timeout old fires, counts as a missed heartbeat, sets the clock and asks for recovery. While
    another recovery is open the request is ignored and the check goes on; otherwise it is applied
    (``applied``), and monitoring stops until the next valid acknowledgement, as it does for every other
    applied recovery and for a disconnect. All arrival buckets of an instrument are folded at once: a run
    depends on when the clock started only where a silence is long enough to fire.
    """
    rows = frames.select(*lane.keys, lane.pos, "kind", F.col(at).alias("at_ns"))
    events = feed_events(rows, FeedRules(buffered=False, timeout=timeout, restart=restart), lane, horizon_ns)
    fired = events.where("cause = 'timeout' and since_ns is not null")
    return fired.select(*lane.keys, F.col("at_ns").alias("fired_ns"), "since_ns", "applied")
