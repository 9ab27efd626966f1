"""Column functions: every one takes and returns Columns and stays in the JVM."""

from feedlake.functions.fixed import fixed_point, fixed_value
from feedlake.functions.ids import opposite_side, uuid_halves, uuid_text
from feedlake.functions.jsontext import (
    first_object_named,
    json_array,
    json_long_prefix,
    json_long_strict,
    json_raw,
    json_string,
    quoted_groups,
    quoted_strings,
)
from feedlake.functions.labels import escape_label, label_name, metric_name, parse_label
from feedlake.functions.times import ntz_nanos, rfc3339_nanos, timestamp_value
from feedlake.functions.wirecodes import decode_code, encode_code, encoded_size, venue_key

__all__ = [
    "decode_code",
    "encode_code",
    "encoded_size",
    "escape_label",
    "first_object_named",
    "fixed_point",
    "fixed_value",
    "json_array",
    "json_long_prefix",
    "json_long_strict",
    "json_raw",
    "json_string",
    "label_name",
    "metric_name",
    "ntz_nanos",
    "opposite_side",
    "parse_label",
    "quoted_groups",
    "quoted_strings",
    "rfc3339_nanos",
    "timestamp_value",
    "uuid_halves",
    "uuid_text",
    "venue_key",
]
