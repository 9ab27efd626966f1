"""Queries over the scalar functions, on texts derived from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import (
    decode_code,
    encode_code,
    encoded_size,
    escape_label,
    fixed_point,
    fixed_value,
    json_array,
    json_long_prefix,
    json_long_strict,
    json_raw,
    json_string,
    label_name,
    metric_name,
    parse_label,
    quoted_strings,
    rfc3339_nanos,
    timestamp_value,
    uuid_halves,
    uuid_text,
    venue_key,
)
from feedlake.functions.wirecodes import CODES
from feedlake.plans.oracle import L2_KINDS, fixed_m, fixed_s, raw_field, signed_half, text_field, times_ns
from feedlake.plans.registration import Family
from feedlake.plans.views import L3_FRAMES_SQL, duck_text, l2_frames, l3_frames, spark_text, table

FAMILY = Family()
register = FAMILY.register

_NUMBER_TEXT = """case l_linenumber + 7 * (l_orderkey % 3)
  when 1 then concat('-', PRICE) when 2 then concat(PRICE, '"junk') when 3 then '1e5' when 4 then concat('.', cast(l_partkey as TXT))
  when 5 then concat(cast(l_partkey as TXT), '.') when 6 then concat(PRICE, '00000000000000000') when 7 then '9223372036854775807'
  when 8 then concat('  "', PRICE, '"') when 9 then concat(PRICE, ',12') when 10 then '' when 11 then '1.2.3' when 12 then '-'
  when 13 then concat(cast(l_suppkey as TXT), '0000000000000000000') when 14 then '-9223372036854775807'
  when 15 then concat('000000000000000000000', PRICE) when 16 then concat(PRICE, 'x') when 17 then concat('0.', cast(l_partkey as TXT), '] ')
  else PRICE end""".replace("PRICE", "cast(cast(l_extendedprice as decimal(18,2)) as TXT)")


@register(
    "f1_decimal_texts",
    f"""with t as (select l_orderkey, l_linenumber, l_partkey, {duck_text(_NUMBER_TEXT)} as txt from lineitem),
p as (select *, {fixed_m("txt")} as m, {fixed_s("txt")} as s from t)
select txt, cast(m as bigint) as m, case when m is not null then s end as s, count(*) as n from p group by all""",
)
def f1_decimal_texts(spark, sf_dir):
    texts = table(spark, sf_dir, "lineitem").select(F.expr(spark_text(_NUMBER_TEXT)).alias("txt"))
    counted = texts.groupBy("txt").agg(F.count("*").alias("n")).withColumn("p", fixed_point(F.col("txt")))
    return counted.select("txt", F.col("p.m").alias("m"), F.col("p.s").alias("s"), "n")


@register(
    "f2_fixed_value",
    """with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_extendedprice as decimal(18,2)) * 100 * case when l_linenumber % 2 = 0 then -1 else 1 end as mm,
  cast(l_partkey % 19 as integer) as s from lineitem),
d as (select *, lpad(cast(cast(abs(mm) as bigint) as varchar), 38, '0') as digits from t)
select cast(mm as bigint) as m, s, try_cast(concat(case when mm < 0 then '-' else '' end, substr(digits, 1, 38 - s), '.', substr(digits, 39 - s, s), '0') as decimal(38,18)) as value,
  count(*) as n from d group by all""",
)
def f2_fixed_value(spark, sf_dir):
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    cents = (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("bigint") * sign
    rows = table(spark, sf_dir, "lineitem").select(
        cents.alias("m"), (F.col("l_partkey") % 19).cast("int").alias("s")
    )
    return rows.groupBy("m", "s").agg(F.count("*").alias("n")).withColumn("value", fixed_value(F.col("m"), F.col("s")))


_ID_TEXT = """case o_orderkey % 8
  when 0 then concat(substr(H, 1, 8), '-', substr(H, 9, 4), '-', substr(H, 13, 4), '-', substr(H, 17, 4), '-', substr(H, 21, 12))
  when 1 then upper(H) when 2 then substr(H, 1, 30) when 3 then concat(H, 'zz') when 4 then concat('--', H) when 5 then concat(substr(H, 1, 5), 'g', substr(H, 7, 26))
  when 6 then concat(substr(H, 1, 3), '-', substr(H, 4, 29)) else H end""".replace("H", "md5(cast(o_orderkey as TXT))")


@register(
    "f3_order_ids",
    f"""with t as (select o_orderkey, {duck_text(_ID_TEXT)} as txt from orders),
h as (select *, case when regexp_matches(txt, '^(-*[0-9a-fA-F][0-9a-fA-F]){{16}}') then lower(substr(replace(txt, '-', ''), 1, 32)) end as x from t)
select o_orderkey, txt, {signed_half("x", 1)} as hi, {signed_half("x", 17)} as lo,
  concat(substr(x, 1, 8), '-', substr(x, 9, 4), '-', substr(x, 13, 4), '-', substr(x, 17, 4), '-', substr(x, 21, 12)) as canonical from h where x is not null
union all select o_orderkey, txt, null, null, null from h where x is null""",
)
def f3_order_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(spark_text(_ID_TEXT)).alias("txt"))
    ids = rows.withColumn("id", uuid_halves(F.col("txt"))).select(
        "o_orderkey", "txt", F.col("id.hi").alias("hi"), F.col("id.lo").alias("lo")
    )
    return ids.withColumn("canonical", F.when(F.col("hi").isNotNull(), uuid_text(F.col("hi"), F.col("lo"))))


_TIME_TEXT = """case o_orderkey % 12
  when 0 then concat(D, 'T00:00:00Z') when 1 then concat(D, 'T23:59:59.', cast(o_orderkey as TXT), 'Z') when 2 then concat(D, 'T24:00:00Z')
  when 3 then concat(D, ' 10:00:00Z') when 4 then concat(D, 'T10:00:00.1234567890Z') when 5 then concat(D, 'T10:00:00+00:00')
  when 6 then '1970-01-01T00:00:00Z' when 7 then concat(substr(D, 1, 8), '31T01:02:03.5Z') when 8 then concat(D, 'T10:00:60Z')
  when 9 then 'null' when 10 then '' else concat(substr(D, 1, 4), '-02-29T06:07:08.000000001Z') end""".replace(
    "D", "cast(cast(o_orderdate as date) as TXT)"
)


@register(
    "f4_f5_times",
    f"""with t as (select o_orderkey, {duck_text(_TIME_TEXT)} as txt from orders)
select o_orderkey, {times_ns("txt")} as ns, {times_ns("txt")} as quoted_ns from t""",
)
def f4_f5_times(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(spark_text(_TIME_TEXT)).alias("txt"))
    quoted = F.when(F.col("txt") == "null", F.col("txt")).otherwise(F.concat(F.lit(' "'), "txt", F.lit('" ,')))
    return rows.select("o_orderkey", rfc3339_nanos(F.col("txt")).alias("ns"), timestamp_value(quoted).alias("quoted_ns"))


_LONG_TEXT = """case l_linenumber when 1 then concat('-', K) when 2 then concat(K, 'x') when 3 then concat(K, '0000000000000000000') when 4 then ''
  when 5 then '9223372036854775807' else K end""".replace("K", "cast(l_orderkey as TXT)")


@register(
    "f6_longs",
    f"""with t as (select {duck_text(_LONG_TEXT)} as txt from lineitem)
select txt, nullif(case when regexp_full_match(txt, '[0-9]+') then try_cast(txt as bigint) end, 9223372036854775807) as strict_value,
  case when regexp_extract(txt, '^[0-9]*') = '' then 0 else coalesce(try_cast(regexp_extract(txt, '^[0-9]*') as bigint), 9223372036854775807) end as prefix_value,
  count(*) as n from t group by all""",
)
def f6_longs(spark, sf_dir):
    texts = table(spark, sf_dir, "lineitem").select(F.expr(spark_text(_LONG_TEXT)).alias("txt"))
    counted = texts.groupBy("txt").agg(F.count("*").alias("n"))
    return counted.select(
        "txt",
        json_long_strict(F.col("txt")).alias("strict_value"),
        json_long_prefix(F.col("txt")).alias("prefix_value"),
        "n",
    )


@register(
    "f7_f8_json_fields",
    f"""with v as ({duck_text(L3_FRAMES_SQL)}) select o_orderkey, {text_field("payload", "type")} as type, {text_field("payload", "name")} as name,
  {text_field("payload", "price")} as price_text, {raw_field("payload", "price")} as price_raw, {raw_field("payload", "sequence")} as sequence,
  {raw_field("payload", "trade_id")} as trade_id from v""",
)
def f7_f8_json_fields(spark, sf_dir):
    payload = F.col("payload")
    return l3_frames(spark, sf_dir).select(
        "o_orderkey",
        json_string(payload, "type").alias("type"),
        json_string(payload, "name").alias("name"),
        json_string(payload, "price").alias("price_text"),
        json_raw(payload, "price").alias("price_raw"),
        json_raw(payload, "sequence").alias("sequence"),
        json_raw(payload, "trade_id").alias("trade_id"),
    )


@register(
    "f9_array_elements",
    f"""with {L2_KINDS}, a as (select instrument_id, arrival, regexp_extract(payload, '"changes":(.*)}}', 1) as arr from f where t = 'l2update'),
e as (select instrument_id, arrival, regexp_extract_all(arr, '"([^"]*)"', 1) as items from a)
select instrument_id, arrival, cast(i - 1 as integer) as pos, items[i] as item from e, range(1, 4) r(i)""",
)
def f9_array_elements(spark, sf_dir):
    items = quoted_strings(json_array(F.col("payload"), "changes"))
    return l2_frames(spark, sf_dir).select(
        "instrument_id", "arrival", F.posexplode_outer(items).alias("pos", "item")
    ).where("pos is not null")


def _names(family: str, value: str) -> str:
    return f"case {value} " + " ".join(f"when {k} then '{v}'" for k, v in CODES[family].items()) + " end"


@register(
    "f10_code_names",
    f"""select event_id, {_names("venue", "event_id % 10")} as venue, {_names("depth", "event_id % 5")} as depth, {_names("template", "event_id % 5")} as template,
  {_names("event", "event_id % 6")} as event, {_names("side", "event_id % 4")} as side, {_names("action", "event_id % 4")} as action,
  {_names("order_type", "event_id % 5")} as order_type, {_names("reason", "event_id % 10")} as reason,
  case when event_id % 10 between 1 and 8 then cast(event_id % 10 as integer) end as venue_code,
  lower(regexp_extract({_names("venue", "event_id % 10")}, '^([^_]*)', 1)) as venue_key from events""",
)
def f10_code_names(spark, sf_dir):
    """F15 as well: the family key of the venue name."""
    ident = F.col("event_id")
    spans = {"venue": 10, "depth": 5, "template": 5, "event": 6, "side": 4, "action": 4, "order_type": 5, "reason": 10}
    venue = decode_code("venue", ident % 10)
    return table(spark, sf_dir, "events").select(
        "event_id",
        *[decode_code(family, ident % span).alias(family) for family, span in spans.items()],
        encode_code("venue", venue).alias("venue_code"),
        venue_key(venue).alias("venue_key"),
    )


_LABEL_TEXT = """concat(case when event_id % 5 = 0 then '  ' when event_id % 5 = 1 then '9' when event_id % 5 = 2 then '' else 'a:' end,
  event_type, case when event_id % 3 = 0 then '._-' when event_id % 3 = 1 then ' rate/s' else '' end)"""


def _clean(text: str, allowed: str) -> str:
    return f"regexp_replace(regexp_replace(ltrim({text}, ' '), '[^{allowed}]', '_', 'g'), '_+$', '')"


def _safe(name: str) -> str:
    return f"case when regexp_matches({name}, '^[0-9]') then concat('_', {name}) else {name} end"


@register(
    "f11_names",
    f"""with t as (select event_id, case when event_id % 17 = 0 then '..' else {_LABEL_TEXT} end as txt from events)
select txt, case when {_clean("txt", "a-zA-Z0-9_:")} = '' then 'fallback' else {_safe(_clean("txt", "a-zA-Z0-9_:"))} end as metric,
  {_safe(_clean("trim(txt)", "a-zA-Z0-9_"))} as label, count(*) as n from t group by all""",
)
def f11_names(spark, sf_dir):
    text = F.when(F.col("event_id") % 17 == 0, F.lit("..")).otherwise(F.expr(_LABEL_TEXT))
    counted = table(spark, sf_dir, "events").select(text.alias("txt")).groupBy("txt").agg(F.count("*").alias("n"))
    return counted.select(
        "txt", metric_name(F.col("txt"), F.lit("fallback")).alias("metric"), label_name(F.col("txt")).alias("label"), "n"
    )


@register(
    "f12_escape",
    r"""select doc_id, replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') as escaped from documents""",
)
def f12_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", escape_label(F.col("text")).alias("escaped"))


@register(
    "f13_label_pairs",
    """with p as (select event_id, unnest([concat('instanceId=', event_type), concat('=', event_type), 'plain', concat(' k ', '=', props), 'instrumentId=a=b']) as part,
  unnest([1, 2, 3, 4, 5]) as i from events)
select event_id, case when i = 1 then 0 when i = 4 then 1 else 2 end as pos,
  case when i = 1 then 'instance_id' when i = 4 then 'k' else 'instrument_id' end as name,
  substr(part, instr(part, '=') + 1) as value from p where instr(part, '=') > 1""",
)
def f13_label_pairs(spark, sf_dir):
    label = F.concat(
        F.lit("metric,instanceId="), "event_type", F.lit(",="), "event_type", F.lit(",plain, k ="), "props", F.lit(",instrumentId=a=b")
    )
    pairs = table(spark, sf_dir, "events").select("event_id", F.posexplode(parse_label(label)).alias("pos", "pair"))
    return pairs.select("event_id", "pos", F.col("pair.name").alias("name"), F.col("pair.value").alias("value"))


@register(
    "f17_message_sizes",
    """select l_linenumber % 4 as template, l_partkey as entries,
  case l_linenumber % 4 when 1 then 59 + l_partkey * 20 when 2 then 59 + l_partkey * 55 when 3 then 59 + l_partkey * 51 end as bytes,
  count(*) as n from lineitem group by all""",
)
def f17_message_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 4).alias("template"), F.col("l_partkey").alias("entries")
    )
    counted = rows.groupBy("template", "entries").agg(F.count("*").alias("n"))
    return counted.withColumn("bytes", encoded_size(F.col("template"), F.col("entries")))
