"""Recovery requests against the connector table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.operators.counters import count_if
from feedlake.operators.ordering import spread_join


def route_requests(requests: DataFrame, connectors: DataFrame, own_venue: int, spread: str = "request_id") -> DataFrame:
    """Add ``outcome``: ``accepted`` when a connector serves (venue, instrument), else ``unknown`` for the
    own venue and ``rejected`` for a foreign one."""
    known = connectors.select("venue", "instrument_id", F.lit(True).alias("_known"))
    routed = spread_join(requests, known, ["venue", "instrument_id"], "left", spread)
    outcome = (
        F.when(F.col("_known"), "accepted").when(F.col("venue") == own_venue, "unknown").otherwise("rejected")
    )
    return routed.withColumn("outcome", outcome).drop("_known")


def duplicate_routes(connectors: DataFrame) -> DataFrame:
    """Connector keys that appear more than once."""
    return (
        connectors.groupBy("venue", "instrument_id").agg(F.count("*").alias("connectors")).where("connectors > 1")
    )


def batch_result(routed: DataFrame, *keys: str) -> DataFrame:
    """Decoded / accepted / rejected / unknown / malformed per batch."""
    outcome = F.col("outcome")
    return routed.groupBy(*keys).agg(
        count_if(outcome != "malformed").alias("decoded"),
        count_if(outcome == "accepted").alias("accepted"),
        count_if(outcome == "rejected").alias("rejected"),
        count_if(outcome == "unknown").alias("unknown_instrument"),
        count_if(outcome == "malformed").alias("malformed"),
    )
