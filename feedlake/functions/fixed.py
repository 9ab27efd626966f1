"""Fixed-point decimals: (mantissa, scale) exactly as written, never through DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake.functions.binding import let

# The largest mantissa, which at scale 0 stands for "no value", and the scale limit.
MAX_MANTISSA = 9223372036854775807
MAX_SCALE = 18

# Leading blanks and one quote are skipped; the number ends at the first JSON delimiter.
_TOKEN = r'^[ \n\r\t]*"?(-?[0-9]*\.?[0-9]*)(?:[",\]} \n\r\t]|$)'


def fixed_token(text: Column) -> Column:
    """The numeric token of ``text``, or '' when the text is not a plain decimal."""
    return F.regexp_extract(text, _TOKEN, 1)


def _assemble(token: Column, mantissa: Column) -> Column:
    dot = F.instr(token, ".")
    scale = F.when(dot > 0, F.length(token) - dot).otherwise(F.lit(0))
    negative = token.startswith("-")
    reserved = (mantissa == MAX_MANTISSA) & (scale == 0) & ~negative
    usable = mantissa.isNotNull() & (scale <= MAX_SCALE) & ~reserved
    signed = F.when(negative, -mantissa).otherwise(mantissa)
    return F.when(usable, F.struct(signed.alias("m"), scale.cast("int").alias("s")))


def _mantissa(token: Column) -> Column:
    return F.translate(token, "-.", "").try_cast("bigint")


def fixed_point(text: Column) -> Column:
    """Parse decimal text to ``struct<m bigint, s int>``, NULL when invalid.

    The token and its mantissa are bound, so the regex and the cast run once per value.
    """
    return let(fixed_token(text), lambda token: let(_mantissa(token), lambda m: _assemble(token, m)))


def fixed_value(mantissa: Column, scale: Column) -> Column:
    """DECIMAL(38,18) value for comparing across scales; NULL when it does not fit."""
    digits = F.lpad(F.abs(mantissa).cast("string"), 38, "0")
    whole = F.substring(digits, F.lit(1), F.lit(38) - scale)
    fraction = digits.substr(F.lit(39) - scale, scale)
    sign = F.when(mantissa < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole, F.lit("."), fraction, F.lit("0")).try_cast("decimal(38,18)")
