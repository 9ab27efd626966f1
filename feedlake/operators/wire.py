"""Binary message jobs: bulk encode and decode of message tables.

Both run as Arrow batches through numpy: all fixed-width fields of a batch are written or read with a
handful of array operations, with no shuffle and no per-row Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.functions.wirecodes import MAX_ENTRIES

# Little-endian message layout.
MAGIC, VERSION, BLOCK_LENGTH, HEADER_LENGTH = 0xEB0B, 2, 51, 8
HEADER = np.dtype([("magic", "<u2"), ("version", "u1"), ("template_id", "u1"), ("block_length", "<u2"), ("entry_count", "<u2")])
BODY = np.dtype([
    ("event_type", "u1"), ("venue", "u1"), ("book_depth", "u1"), ("instrument_id", "<i4"), ("gateway_seq", "<i8"),
    ("seq1", "<i8"), ("seq2", "<i8"), ("exchange_ns", "<i8"), ("ingress_ns", "<i8"), ("checksum", "<u4"),
])
ENTRIES = {
    1: np.dtype([
        ("side", "u1"), ("action", "u1"), ("price_s", "u1"), ("qty_s", "u1"), ("price_m", "<i8"), ("qty_m", "<i8"),
    ]),
    2: np.dtype([
        ("id_high", "<i8"), ("id_low", "<i8"), ("side", "u1"), ("action", "u1"), ("reason", "u1"), ("order_type", "u1"),
        ("price_s", "u1"), ("qty_s", "u1"), ("old_qty_s", "u1"), ("order_ns", "<i8"), ("price_m", "<i8"),
        ("qty_m", "<i8"), ("old_qty_m", "<i8"),
    ]),
    3: np.dtype([
        ("maker_high", "<i8"), ("maker_low", "<i8"), ("taker_high", "<i8"), ("taker_low", "<i8"), ("taker_side", "u1"),
        ("price_s", "u1"), ("qty_s", "u1"), ("price_m", "<i8"), ("qty_m", "<i8"),
    ]),
}

_BODY_INPUT = [n for n in BODY.names if n != "checksum"]


def _sql_type(kind: np.dtype) -> T.DataType:
    return T.LongType() if kind.itemsize == 8 else T.IntegerType()


#: Most bytes of one output batch; binary columns count their bytes in 32 bits.
BATCH_BYTES = 1 << 30


def _portions(batch: pa.RecordBatch, prefix: int, entry: int, limit: int | None = None):
    """Cut a batch so that the messages of each part stay under ``limit`` bytes."""
    limit = limit or BATCH_BYTES
    sizes = prefix + np.diff(np.asarray(batch.column("_e").offsets).astype(np.int64)) * entry
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encode_messages(messages: DataFrame, template: int, *keep: str) -> DataFrame:
    """``keep`` columns and ``message`` (binary) for rows with the body columns and an ``entries`` array.

    The array holds structs with the entry fields of ``template``; resets have an empty array. Rows
    over the entry cap must be refused before (see ``over_cap``).
    """
    entry = ENTRIES[template]
    prefix = HEADER.itemsize + BODY.itemsize
    schema = messages.select(*keep).schema.add("message", T.BinaryType())
    ordered = messages.select(
        *keep,
        *[F.col(n).cast("bigint").alias(f"_b_{n}") for n in _BODY_INPUT],
        F.transform("entries", lambda e: F.struct(*[e[n].cast("bigint").alias(n) for n in entry.names])).alias("_e"),
    )

    def encode(batches):
        for batch in (part for whole in batches for part in _portions(whole, prefix, entry.itemsize)):
            rows = batch.num_rows
            lists = batch.column("_e")
            starts = np.asarray(lists.offsets)
            counts = np.diff(starts)
            flat = lists.flatten()
            head = np.zeros(rows, np.dtype([("h", HEADER), ("b", BODY)]))
            head["h"]["magic"], head["h"]["version"], head["h"]["template_id"] = MAGIC, VERSION, template
            head["h"]["block_length"], head["h"]["entry_count"] = BLOCK_LENGTH, counts
            for name in _BODY_INPUT:
                head["b"][name] = batch.column(f"_b_{name}").to_numpy(zero_copy_only=False)
            group = np.zeros(len(flat), entry)
            for name in entry.names:
                group[name] = flat.field(name).to_numpy(zero_copy_only=False)
            at = np.zeros(rows + 1, np.int32)
            np.cumsum(prefix + counts * entry.itemsize, out=at[1:])
            out = np.empty(at[-1], np.uint8)
            out[at[:-1, None] + np.arange(prefix)] = head.view(np.uint8).reshape(rows, prefix)
            if len(group):
                within = np.arange(len(group)) - np.repeat(starts[:-1] - starts[0], counts)
                first = np.repeat(at[:-1] + prefix, counts) + within * entry.itemsize
                out[first[:, None] + np.arange(entry.itemsize)] = group.view(np.uint8).reshape(-1, entry.itemsize)
            message = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(at), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], message], names=[*keep, "message"]
            )

    return ordered.mapInArrow(encode, schema)


def _gather(data: np.ndarray, at: np.ndarray, dtype: np.dtype) -> np.ndarray:
    if not len(at):
        return np.zeros(0, dtype)
    return np.ascontiguousarray(data[at[:, None] + np.arange(dtype.itemsize)]).view(dtype).reshape(-1)


def _read_prefix(column: pa.Array):
    """Bytes, starts, lengths, header and body of each message; NULL or short messages read as zeros."""
    column = column.fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lengths = np.diff(at)
    whole = lengths >= HEADER.itemsize + BODY.itemsize
    head, body = np.zeros(len(lengths), HEADER), np.zeros(len(lengths), BODY)
    head[whole] = _gather(data, at[:-1][whole], HEADER)
    body[whole] = _gather(data, at[:-1][whole] + HEADER.itemsize, BODY)
    sizes = np.zeros(256, np.int64)
    for template, entry in ENTRIES.items():
        sizes[template] = entry.itemsize
    size = sizes[head["template_id"]]
    group = at[:-1] + HEADER_LENGTH + head["block_length"]
    valid = (
        whole
        & (head["magic"] == MAGIC)
        & (head["version"] == VERSION)
        & (head["block_length"] >= BODY.itemsize)
        & (size > 0)
        & (head["entry_count"] <= MAX_ENTRIES)
        & (group + head["entry_count"] * size <= at[1:])
    )
    return data, group, head, body, valid


def decode_messages(table: DataFrame, *keep: str, message: str = "message") -> DataFrame:
    """Header and body columns of each message plus ``valid``; fields of an invalid message are NULL."""
    fields = [("template_id", HEADER), ("entry_count", HEADER), *[(n, BODY) for n in _BODY_INPUT]]
    schema = table.select(*keep).schema.add("valid", T.BooleanType())
    for name, part in fields:
        schema = schema.add(name, _sql_type(part[name]))

    def decode(batches):
        for batch in batches:
            _, _, head, body, valid = _read_prefix(batch.column(message))
            arrays = [batch.column(c) for c in keep] + [pa.array(valid)]
            for name, part in fields:
                values = (head if part is HEADER else body)[name]
                kind = pa.int64() if part[name].itemsize == 8 else pa.int32()
                arrays.append(pa.array(values.astype(np.int64), mask=~valid).cast(kind))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return table.select(*keep, message).mapInArrow(decode, schema)


def decode_entries(table: DataFrame, template: int, *keep: str, message: str = "message") -> DataFrame:
    """One row per entry of the valid messages of a template: ``keep``, body fields, ``entry_pos``, entry fields.

    The group is found by the block length in the header, so longer bodies of later versions decode.
    """
    entry = ENTRIES[template]
    schema = table.select(*keep).schema
    for name in _BODY_INPUT:
        schema = schema.add(f"msg_{name}", _sql_type(BODY[name]))
    schema = schema.add("entry_pos", T.IntegerType())
    for name in entry.names:
        schema = schema.add(name, _sql_type(entry[name]))

    def decode(batches):
        for batch in batches:
            data, group, head, body, valid = _read_prefix(batch.column(message))
            rows = np.flatnonzero(valid & (head["template_id"] == template))
            counts = head["entry_count"][rows].astype(np.int64)
            owner = np.repeat(rows, counts)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            entries = _gather(data, group[owner] + within * entry.itemsize, entry)
            index = pa.array(owner, pa.int64())
            arrays = [batch.column(c).take(index) for c in keep]

            def plain(values, dtype):
                return pa.array(values.astype(np.int64)).cast(pa.int64() if dtype.itemsize == 8 else pa.int32())

            arrays += [plain(body[name][owner], BODY[name]) for name in _BODY_INPUT]
            arrays.append(pa.array(within.astype(np.int32)))
            arrays += [plain(entries[name], entry[name]) for name in entry.names]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return table.select(*keep, message).mapInArrow(decode, schema)


# Recovery request control messages.
REQUEST_SINGLE, REQUEST_BATCH = 101, 102
SINGLE_BLOCK, BATCH_BLOCK, MAX_TEXT = 18, 14, 65_535


def _le_hex(value: Column, size: int) -> Column:
    """Little-endian hex digits of an integer column."""
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)])


def _control_header(template: int, block: int, entries: Column) -> Column:
    fixed = F.lit(f"{MAGIC & 0xFF:02X}{MAGIC >> 8:02X}{VERSION:02X}{template:02X}{block & 0xFF:02X}{block >> 8:02X}")
    return F.concat(fixed, _le_hex(entries, 2))


def encode_request(venue: Column, instrument: Column, request_type: Column, reason: Column, at_ns: Column, text: Column) -> Column:
    """One recovery request message; NULL when the text is too long. A NULL text is empty."""
    body = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(body)
    code = F.concat(
        _control_header(REQUEST_SINGLE, SINGLE_BLOCK, F.lit(0)),
        _le_hex(venue, 1), _le_hex(request_type, 1), _le_hex(reason, 1), F.lit("00"),
        _le_hex(instrument, 4), _le_hex(at_ns, 8), _le_hex(size, 2), F.hex(body),
    )
    return F.when(size <= MAX_TEXT, F.unhex(code))


def encode_request_batch(venue: Column, instruments: Column, request_type: Column, reason: Column, at_ns: Column) -> Column:
    """One message for 1 to 10 000 instrument ids; NULL outside that range. Batches carry no text."""
    count = F.size(instruments)
    code = F.concat(
        _control_header(REQUEST_BATCH, BATCH_BLOCK, count),
        _le_hex(venue, 1), _le_hex(request_type, 1), _le_hex(reason, 1), F.lit("00"),
        _le_hex(at_ns, 8), F.lit("0000"), F.array_join(F.transform(instruments, lambda i: _le_hex(i, 4)), ""),
    )
    return F.when(count.between(1, MAX_ENTRIES), F.unhex(code))


def _from_le(digits: Column, at: Column, size: int) -> Column:
    """Integer at byte ``at`` of a hex text: unsigned up to 2 bytes, signed at 4 and 8."""
    pairs = [F.substring(digits, at * 2 + 1 + 2 * i, F.lit(2)) for i in reversed(range(size))]
    big = F.concat(*pairs)
    if size < 8:
        # Sign-extend four-byte values; shorter ones are unsigned.
        value = F.conv(big, 16, 10).try_cast("bigint")
        return F.when(value >= 2**31, value - 2**32).otherwise(value) if size == 4 else value
    return F.conv(big, 16, -10).try_cast("bigint")


def decode_requests(table: DataFrame, *keep: str, message: str = "message") -> DataFrame:
    """One row per requested instrument; a malformed message gives one row with ``malformed`` set."""
    h = F.col("_hex")
    header = table.select(*keep, F.hex(message).alias("_hex")).select(
        *keep,
        "_hex",
        (F.length(h) / 2).cast("int").alias("_len"),
        _from_le(h, F.lit(0), 2).alias("_magic"),
        _from_le(h, F.lit(2), 1).alias("_version"),
        _from_le(h, F.lit(3), 1).alias("_template"),
        _from_le(h, F.lit(4), 2).alias("_block"),
        _from_le(h, F.lit(6), 2).cast("int").alias("_count"),
        _from_le(h, F.lit(8), 1).alias("venue"),
        _from_le(h, F.lit(9), 1).alias("request_type"),
        _from_le(h, F.lit(10), 1).alias("reason_code"),
    )
    single = F.col("_template") == REQUEST_SINGLE
    sized = header.withColumn(
        "_text", F.when(single, _from_le(h, F.lit(24), 2)).otherwise(_from_le(h, F.lit(20), 2)).cast("int")
    )
    whole = (F.col("_magic") == MAGIC) & (F.col("_version") == VERSION)
    as_single = (
        single
        & (F.col("_block") == SINGLE_BLOCK)
        & (F.col("_count") == 0)
        & (F.col("_len") == HEADER_LENGTH + SINGLE_BLOCK + F.col("_text"))
    )
    as_batch = (
        (F.col("_template") == REQUEST_BATCH)
        & (F.col("_block") == BATCH_BLOCK)
        & (F.col("_count") > 0)
        & (F.col("_len") == HEADER_LENGTH + BATCH_BLOCK + F.col("_text") + F.col("_count") * 4)
    )
    known = F.col("venue").between(1, 8) & F.col("request_type").between(1, 3) & F.col("reason_code").between(1, 6)
    checked = sized.withColumn("malformed", ~F.coalesce(whole & (as_single | as_batch) & known, F.lit(False)))
    start = F.lit(HEADER_LENGTH) + F.col("_block").cast("int")
    ids = F.when(single, F.array(_from_le(h, F.lit(12), 4))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.col("_count") - 1, F.lit(0))),
            lambda i: _from_le(h, start + F.col("_text") + i * 4, 4),
        )
    )
    text = F.unhex(F.substring(h, start * 2 + 1, F.col("_text") * 2)).cast("string")
    good = ~F.col("malformed")
    rows = checked.select(
        *keep,
        "malformed",
        *[F.when(good, F.col(c)).cast("int").alias(c) for c in ("venue", "request_type", "reason_code")],
        F.when(good, F.when(single, _from_le(h, F.lit(16), 8)).otherwise(_from_le(h, F.lit(12), 8))).alias("at_ns"),
        F.when(good & (F.col("_text") > 0), text).alias("text"),
        F.when(good, ids).alias("_ids"),
    )
    return rows.select(
        *keep, "malformed", "venue", "request_type", "reason_code", "at_ns", "text",
        F.explode_outer("_ids").alias("instrument_id"),
    )
