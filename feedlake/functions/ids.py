"""128-bit order ids as two signed longs, and the side flip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake.functions.binding import let

# Hyphens may stand between byte pairs; text after the 16th byte is ignored. The two usual spellings
# come first because they match without a loop.
_HEX = "[0-9a-fA-F]"
_UUID = (
    r'^[ \n\r\t]*+"?+('
    rf"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}|{_HEX}{{32}}|(?:-*+{_HEX}{{2}}){{16}})"
)


def is_uuid(text: Column) -> Column:
    """Whether :func:`uuid_halves` would accept the text."""
    return text.rlike(_UUID)


def _digits(text: Column) -> Column:
    return F.translate(F.regexp_extract(text, _UUID, 1), "-", "")


def _halves(digits: Column, allow_zero: bool) -> Column:
    halves = F.struct(
        F.conv(F.substring(digits, 1, 16), 16, -10).cast("bigint").alias("hi"),
        F.conv(F.substring(digits, 17, 16), 16, -10).cast("bigint").alias("lo"),
    )
    usable = digits != ""
    if not allow_zero:
        usable = usable & (digits != "0" * 32)
    return F.when(usable, halves)


def uuid_halves(text: Column, allow_zero: bool = True) -> Column:
    """``struct<hi bigint, lo bigint>`` of a UUID text; NULL when malformed."""
    return let(_digits(text), lambda digits: _halves(digits, allow_zero))


def _hex16(half: Column) -> Column:
    return F.lpad(F.lower(F.hex(half)), 16, "0")


def uuid_text(high: Column, low: Column) -> Column:
    """Canonical 8-4-4-4-12 text of two halves."""
    h, lo = _hex16(high), _hex16(low)
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.substring(h, 13, 4),
        F.substring(lo, 1, 4),
        F.substring(lo, 5, 12),
    )


def opposite_side(side: Column) -> Column:
    """Maker side of a taker side (1 = bid, 2 = ask)."""
    return F.lit(3) - side
