"""RFC 3339 times as epoch nanoseconds in BIGINT (-1 = absent or invalid)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake.functions.binding import let

NO_TIMESTAMP = -1
_NANOS = 1_000_000_000
# One regex validates and cuts: blanks around and a pair of quotes are allowed.
_RFC3339 = (
    r'^[ \n\r\t]*("?)'
    r"([0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,9})?Z)"
    r"\1[ \n\r\t]*$"
)


def _nanos(value: Column) -> Column:
    day = F.unix_date(F.substring(value, 1, 10).try_cast("date")).cast("bigint")
    seconds = (
        day * 86_400
        + F.substring(value, 12, 2).try_cast("bigint") * 3_600
        + F.substring(value, 15, 2).try_cast("bigint") * 60
        + F.substring(value, 18, 2).try_cast("bigint")
    )
    fraction = F.rpad(F.rtrim(F.substring(value, 21, 10), F.lit("Z")), 9, "0").try_cast("bigint")
    nanos = F.try_add(F.try_multiply(seconds, F.lit(_NANOS)), fraction)
    return F.coalesce(F.nullif(nanos, F.lit(0)), F.lit(NO_TIMESTAMP)).cast("bigint")


def rfc3339_nanos(text: Column) -> Column:
    """Epoch nanos of ``YYYY-MM-DDTHH:MM:SS[.fraction]Z``; -1 for anything else and for epoch zero."""
    return let(F.regexp_extract(text, _RFC3339, 2), _nanos)


def timestamp_value(text: Column) -> Column:
    """Epoch nanos of a JSON value that is quoted, bare or null."""
    token = F.regexp_extract(text, r'^[ \n\r\t]*+("[^"]*+"?|[^",\]} \n\r\t]*+)', 1)
    return rfc3339_nanos(F.translate(token, '"', ""))


def ntz_nanos(ts: Column) -> Column:
    """Epoch nanos of a zone-less timestamp column, independent of the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz")) * 1_000
