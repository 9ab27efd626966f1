"""Counters as metrics text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions.labels import escape_label, metric_name, parse_label


def counter_labels(counters: DataFrame, instance: str, environment: str, venue: str, ident: str = "instrument_id") -> DataFrame:
    """Wide counters to ``(label, value)``: ``gateway_<name>,instanceId=..,..,instrumentId=..``."""
    names = [c for c in counters.columns if c != ident]
    long = counters.unpivot([ident], names, "name", "value")
    shared = f",instanceId={instance},environment={environment},venue={venue},instrumentId="
    return long.select(
        F.concat(F.lit("gateway_"), "name", F.lit(shared), F.col(ident).cast("string")).alias("label"), "value"
    )


def to_prometheus(labelled: DataFrame, fallback: str = "gateway_counter") -> DataFrame:
    """One text ``line`` per counter: ``name{label="value",...} value``."""
    name = metric_name(F.substring_index("label", ",", 1), F.lit(fallback))
    parsed = labelled.select("value", name.alias("name"), parse_label(F.col("label")).alias("labels"))
    rendered = F.array_join(
        F.transform("labels", lambda p: F.concat(p["name"], F.lit('="'), escape_label(p["value"]), F.lit('"'))), ","
    )
    body = F.when(F.size("labels") > 0, F.concat(F.lit("{"), rendered, F.lit("}"))).otherwise("")
    return parsed.select(F.concat("name", body, F.lit(" "), F.col("value").cast("string")).alias("line"))
