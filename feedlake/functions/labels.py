"""Metric and label names of the text metrics export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clean(text: Column, allowed: str) -> Column:
    replaced = F.regexp_replace(F.regexp_replace(text, "^ +", ""), f"[^{allowed}]", "_")
    return F.regexp_replace(replaced, "_+$", "")


def _digit_safe(name: Column) -> Column:
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name)


def metric_name(text: Column, fallback: Column) -> Column:
    """Legal metric name: illegal characters become '_', trailing '_' go, empty gives ``fallback``."""
    cleaned = _clean(F.coalesce(text, F.lit("")), "a-zA-Z0-9_:")
    return F.when(cleaned == "", fallback).otherwise(_digit_safe(cleaned))


def label_name(text: Column) -> Column:
    """Legal label name; the two camel-case id labels are respelled."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    known = (
        F.when(trimmed == "instanceId", F.lit("instance_id"))
        .when(trimmed == "instrumentId", F.lit("instrument_id"))
        .otherwise(trimmed)
    )
    return _digit_safe(_clean(known, "a-zA-Z0-9_"))


def escape_label(text: Column) -> Column:
    """Escape backslash, double quote and newline."""
    step = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    step = F.replace(step, F.lit('"'), F.lit('\\"'))
    return F.replace(step, F.lit("\n"), F.lit("\\n"))


def parse_label(text: Column) -> Column:
    """``array<struct<name,value>>`` of the ``k=v`` parts after the first comma, in order."""
    parts = F.slice(F.split(text, ",", -1), F.lit(2), F.greatest(F.size(F.split(text, ",", -1)) - 1, F.lit(0)))
    pairs = F.transform(
        F.filter(parts, lambda p: F.instr(p, "=") > 1),
        lambda p: F.struct(
            label_name(F.substring_index(p, "=", 1)).alias("name"),
            p.substr(F.instr(p, "=") + 1, F.length(p)).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: p["name"] != "")
