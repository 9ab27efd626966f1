"""Totals of a stream against the batch counters, whatever the cuts between batches."""

import random

import pytest
from pyspark.sql import functions as F

from feedlake.operators import counters
from feedlake.operators.ordering import Lane
from feedlake.session import fresh_path
from feedlake.streaming import accumulate, read_totals
from feedlake.streaming.accounting import edges_merged, latency_merged

SCHEMA = "instrument_id bigint, arrival bigint, latency bigint, edge string"


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(5)
    # Zeros are frequent, and instrument 4 comes with the last batch only.
    return [
        (key, at, chance.choice([0, 0, 3, 7, 12, 40]), chance.choice(["up", "up", "down", "other"]))
        for key in range(5) for at in range(24) if key < 4 or at >= 18
    ]


def _latency(batch):
    return counters.latency_summary(batch, Lane())


def _edges(batch):
    return counters.connection_summary(batch, Lane(), F.col("edge") == "up", F.col("edge") == "down")


def _values(df):
    return {tuple(str(row[c]) for c in sorted(df.columns)) for row in df.collect()}


@pytest.mark.parametrize(
    ("summary", "merges", "columns"),
    [
        (_latency, {"latency": latency_merged}, counters.latency_columns),
        (_edges, {"edges": edges_merged}, counters.connection_columns),
    ],
)
def test_totals_equal_the_batch_whatever_the_cuts(spark, rows, summary, merges, columns):
    path = fresh_path(spark, "totals")
    step = accumulate(path, ["instrument_id"], summary, merges)
    # The second batch comes twice, as after a failure.
    for number, low, high in ((0, 0, 5), (1, 5, 18), (1, 5, 18), (2, 18, 24)):
        step(spark.createDataFrame([r for r in rows if low <= r[1] < high], SCHEMA), number)
        seen = spark.createDataFrame([r for r in rows if r[1] < high], SCHEMA)
        assert _values(read_totals(spark, path).select("instrument_id", *columns())) == _values(
            summary(seen).select("instrument_id", *columns())
        )


def test_latency_and_edges_follow_a_fold(spark, rows):
    """The batch counters against a loop over the rows."""
    table = spark.createDataFrame(rows, SCHEMA)
    low, state, opens = {}, {}, {}
    for key, _, latency, edge in rows:
        low[key] = latency if low.get(key, 0) == 0 else min(low[key], latency)
        if edge == "up" and not state.get(key):
            opens[key] = opens.get(key, 0) + 1
        if edge in ("up", "down"):
            state[key] = edge == "up"
    assert {r.instrument_id: r.latency_min for r in counters.latency_stats(table, Lane()).collect()} == low
    told = counters.active_connections(table, Lane(), F.col("edge") == "up", F.col("edge") == "down").collect()
    assert {r.instrument_id: (r.opens, r.active_connections) for r in told} == {k: (opens.get(k, 0), int(state[k])) for k in state}


def test_nothing_stored_is_an_error(spark):
    with pytest.raises(ValueError):
        read_totals(spark, fresh_path(spark, "none"))
