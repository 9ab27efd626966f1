"""State machines over streams too long for one task: speculate, verify, repair.

A machine takes the rows of a key in order. Here all buckets of a key run at once, each from a guessed
entry state, and remember which fields of it the run depended on. A pass over one summary per bucket then
walks each key: where the true entry agrees with the guess on these fields the run stands, and fields
it did not write pass through; elsewhere the bucket runs again from what is known by then. Every
round settles the first open bucket of each key at least, and a run rarely depends on much, because
control rows set the state whatever it was. The result is that of running each key in one go.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.operators.ordering import BUCKET, Lane
from feedlake.session import fresh_path


class State:
    """Fields of a machine, with what a run read before it wrote and what it wrote. ``sessions`` only counts up."""

    def __init__(self, fields: dict):
        self.fields = fields
        self.read: set[str] = set()
        self.written: set[str] = set()
        self.sessions = 0

    def get(self, name: str):
        if name not in self.written:
            self.read.add(name)
        return self.fields[name]

    def set(self, name: str, value) -> None:
        self.written.add(name)
        self.fields[name] = value


class Machine(Protocol):
    columns: Sequence[str]
    #: DDL of the events, without keys, position and session.
    event: str

    def initial(self) -> dict: ...

    def step(self, state: State, pos: int, row: tuple) -> list[tuple]:
        """Take a row; return its events (position, session of this run, *event fields)."""


def fold_buckets(rows: DataFrame, machine: Machine, lane: Lane, guess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Events ``(keys, pos, session_id, *machine.event)`` of ``machine`` over the rows of every key.

    ``guess`` may give better first entries than the initial state, as JSON: from the stored rows with their buckets
    to (keys, bucket, entry).
    """
    spark = rows.sparkSession
    folder = fresh_path(spark, "bucketfold")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    data = stored(lane.bucketed(rows.select(*lane.keys, lane.pos, *machine.columns)), "rows")
    every = data.select(*lane.part).distinct()
    start = F.lit(json.dumps(machine.initial()))
    if guess is None:
        entries = every.withColumn("entry", start)
    else:
        first = F.row_number().over(lane.across()) == 1
        told = every.withColumn("_first", first).join(guess(data).select(*lane.part, F.col("entry").alias("_entry")), lane.part, "left")
        entries = told.select(*lane.part, F.when(F.col("_first"), start).otherwise(F.coalesce("_entry", start)).alias("entry"))
    runs, marked = None, None
    turn = 0
    while True:
        used = data if marked is None else data.join(marked.select(*lane.part), lane.part, "left_semi")
        done = stored(_run(used, entries, machine, lane, turn), f"run-{turn}")
        runs = done if runs is None else runs.unionByName(done)
        latest = Window.partitionBy(*lane.part).orderBy(F.desc("turn"))
        ends = runs.where("summary is not null").withColumn("_at", F.row_number().over(latest)).where("_at = 1")
        walked = stored(_walk(ends, machine, lane), f"walk-{turn}")
        marked = walked.where("not settled")
        if marked.isEmpty():
            break
        entries = marked.select(*lane.part, "entry")
        turn += 1
    base = walked.select(*lane.part, "turn", "sessions")
    events = runs.where("event is not null").join(base, [*lane.part, "turn"])
    session = (F.col("event.session") + F.col("sessions")).alias("session_id")
    names = [f.name for f in events.select("event.*").schema if f.name not in ("pos", "session")]
    return events.select(*lane.keys, F.col("event.pos").alias(lane.pos), session, *[F.col(f"event.{n}").alias(n) for n in names])


def _run(data: DataFrame, entries: DataFrame, machine: Machine, lane: Lane, turn: int) -> DataFrame:
    """Run the machine over the buckets of ``entries``; summaries and events as one table."""
    part, names = lane.part, [*lane.part, lane.pos, *machine.columns]
    heads = entries.select(*part, "entry")
    both = data.withColumn("entry", F.lit(None).cast("string")).unionByName(heads, allowMissingColumns=True)
    # The entry row has no position and comes first in its bucket.
    ordered = both.select(*names, "entry").repartition(*part).sortWithinPartitions(*part, F.col(lane.pos).asc_nulls_first())
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.select(*part).schema)
    summary = "struct<entry:string,exit:string,read:string,written:string,sessions:bigint>"
    fields = f"pos:bigint,session:bigint,{','.join(f.strip().replace(' ', ':', 1) for f in machine.event.split(','))}"
    schema = f"{keys}, turn int, summary {summary}, event struct<{fields}>"
    event_names = [f.split(":")[0] for f in fields.split(",")]

    def work(batches):
        key, state, entry = None, None, None
        out: list[tuple] = []

        def finish():
            if state is not None:
                told = (entry, json.dumps(state.fields), json.dumps(sorted(state.read)), json.dumps(sorted(state.written)), state.sessions)
                out.append((key, dict(zip(("entry", "exit", "read", "written", "sessions"), told, strict=True)), None))

        def flush(types):
            columns = [pa.array([k[i] for k, _, _ in out], types[i]) for i in range(len(part))]
            columns.append(pa.array([turn] * len(out), pa.int32()))
            columns.append(pa.array([s for _, s, _ in out], SUMMARY))
            columns.append(pa.array([e for _, _, e in out], event_type))
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*part, "turn", "summary", "event"])

        event_type = pa.struct([(n, _ARROW[t]) for n, t in (f.split(":") for f in fields.split(","))])
        types = None
        for batch in batches:
            types = types or [batch.schema.field(k).type for k in part]
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*names, "entry")]
            width = len(part)
            for row in zip(*columns, strict=True):
                if row[-1] is not None:
                    finish()
                    key, entry = row[:width], row[-1]
                    state = State(json.loads(entry))
                else:
                    for event in machine.step(state, row[width], row[width + 1 : -1]):
                        out.append((key, None, dict(zip(event_names, event, strict=True))))
            yield flush(types)
        finish()
        if out:
            yield flush(types)

    return ordered.mapInArrow(work, schema)


SUMMARY = pa.struct([(n, pa.string()) for n in ("entry", "exit", "read", "written")] + [("sessions", pa.int64())])
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _walk(ends: DataFrame, machine: Machine, lane: Lane) -> DataFrame:
    """True entry of every bucket by its key's summaries; a bucket is ``settled`` if its run holds for it."""
    part = lane.part
    told = ends.select(*part, "turn", "summary.*")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.select(*part).schema)
    width = len(lane.keys)

    def work(batches):
        key, fields, sessions = None, None, 0
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *place, turn, entry, leave, read, written, added in zip(*columns, strict=True):
                if place[:width] != key:
                    key, fields, sessions = place[:width], machine.initial(), 0
                guessed, after = json.loads(entry), json.loads(leave)
                holds = all(guessed[f] == fields[f] for f in json.loads(read))
                out.append((*place, turn, json.dumps(fields), holds, sessions))
                fields = fields | {f: after[f] for f in json.loads(written)}
                sessions += added
            types = [batch.schema.field(i).type for i in range(width + 1)] + [pa.int32(), pa.string(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types],
                names=[*part, "turn", "entry", "settled", "sessions"],
            )

    ordered = told.repartition(*lane.keys).sortWithinPartitions(*lane.keys, BUCKET)
    return ordered.mapInArrow(work, f"{keys}, turn int, entry string, settled boolean, sessions bigint")
