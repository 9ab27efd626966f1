"""Building blocks of the SQL oracles: the same inputs, computed again as plain SQL."""

from __future__ import annotations

from feedlake.plans.views import L2_FRAMES_SQL, duck_text

WS = "[ \\n\\r\\t]*"
STR = '"[^"\\\\]*"'

UPTO = "order by arrival rows between unbounded preceding and current row"
PRIOR = "order by arrival rows between unbounded preceding and 1 preceding"


def text_field(payload: str, key: str) -> str:
    """First quoted value of a key; NULL when it is missing."""
    token = f"""regexp_extract({payload}, '"{key}"{WS}:{WS}({STR})?', 1)"""
    return f"""case when {token} <> '' then trim({token}, '"') end"""


def raw_field(payload: str, key: str) -> str:
    token = f"""regexp_extract({payload}, '"{key}"{WS}:{WS}({STR}|[^",}}\\] \\n\\r\\t][^,}}\\] \\n\\r\\t]*)?', 1)"""
    return f"""case when {token} <> '' then trim({token}, '"') end"""


def fixed_m(text: str) -> str:
    """Mantissa of a decimal text, NULL when invalid."""
    token = f"""regexp_extract({text}, '^[ \\n\\r\\t]*"?(-?[0-9]*\\.?[0-9]*)([",\\]}} \\n\\r\\t]|$)', 1)"""
    digits = f"replace(replace({token}, '-', ''), '.', '')"
    sign = f"case when {token} like '-%' then -1 else 1 end"
    value = f"try_cast({digits} as bigint)"
    scale = f"length({token}) - instr({token}, '.')"
    return (
        f"case when {digits} = '' or ({token} like '%.%' and {scale} > 18) then null "
        f"when {token} not like '%.%' and {token} not like '-%' and {value} = 9223372036854775807 then null "
        f"else {sign} * {value} end"
    )


def fixed_s(text: str) -> str:
    """Scale of a decimal text (only meaningful where the mantissa is not NULL)."""
    token = f"""regexp_extract({text}, '^[ \\n\\r\\t]*"?(-?[0-9]*\\.?[0-9]*)([",\\]}} \\n\\r\\t]|$)', 1)"""
    return f"cast(case when {token} like '%.%' then length({token}) - instr({token}, '.') else 0 end as integer)"


def uuid_digits(text: str) -> str:
    """32 lower-case hex digits of an order id, NULL when malformed."""
    cut = f"""replace(regexp_extract({text}, '^(-*[0-9a-fA-F]{{2}}){{16}}', 0), '-', '')"""
    return f"case when {cut} <> '' then lower({cut}) end"


def signed_half(hex_text: str, start: int) -> str:
    """Signed int64 of 16 hex digits from ``start``."""
    value = f"cast(cast(concat('0x', substr({hex_text}, {start}, 16)) as ubigint) as hugeint)"
    return f"cast(case when {value} >= 9223372036854775808 then {value} - 18446744073709551616 else {value} end as bigint)"


def times_ns(text: str) -> str:
    """Epoch nanos of an RFC 3339 text, -1 when absent, invalid or zero."""
    pattern = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,9})?Z"
    day = f"date_diff('day', date '1970-01-01', try_cast(substr({text}, 1, 10) as date))"
    clock = f"try_cast(substr({text}, 12, 2) as bigint) * 3600 + try_cast(substr({text}, 15, 2) as bigint) * 60 + try_cast(substr({text}, 18, 2) as bigint)"
    frac = f"try_cast(rpad(regexp_extract({text}, '\\.([0-9]+)Z$', 1), 9, '0') as bigint)"
    return (
        f"coalesce(nullif(case when regexp_full_match({text}, '{pattern}') then ({day} * 86400 + {clock}) * 1000000000 "
        f"+ {frac} end, 0), -1)"
    )


# Frames of V1 with their kind. The acknowledgement rule is simplified to what V1 contains.
L2_KINDS = f"""v as ({duck_text(L2_FRAMES_SQL)}),
f as (select instrument_id, arrival, event_id, ts, payload,
    regexp_extract(payload, '"type":"([^"]*)"', 1) as t,
    regexp_extract(payload, '"product_id":"([^"]*)"', 1) as p,
    case when payload like '%"bad"%' then 1 else 0 end as bad from v),
k as (select *, case
    when t = 'subscriptions' and payload not like '%"name":"heartbeat"%' then 'trigger'
    when t = 'subscriptions' then 'ack'
    when p <> concat('P', cast(instrument_id as varchar)) then 'mismatch'
    when t = 'snapshot' and bad = 1 then 'bad_snapshot' when t = 'snapshot' then 'snapshot'
    when t = 'l2update' and bad = 1 then 'bad_update' when t = 'l2update' then 'update'
    else 'heartbeat' end as kind from f)"""

# Session rules over V1 by the parity derivation, as global windows per instrument.
L2_RULES = f"""{L2_KINDS},
g as (select *, sum(case when kind in ('trigger','bad_snapshot') then 1 else 0 end)
        over (partition by instrument_id {UPTO}) as seg from k),
h as (select *, sum(case when kind = 'snapshot' then 1 else 0 end)
        over (partition by instrument_id, seg {UPTO}) % 2 as open_after from g),
i as (select *, coalesce(lag(open_after) over (partition by instrument_id order by arrival), 0) as open_before from h),
j as (select *, case when kind = 'snapshot' and open_before = 0 then arrival end as acc_pos,
    case when kind = 'trigger' or (kind in ('snapshot','bad_snapshot') and open_before = 1) then arrival end as trg_pos from i),
l as (select *, coalesce(max(acc_pos) over (partition by instrument_id {PRIOR}), 0) as pa,
    coalesce(max(trg_pos) over (partition by instrument_id {PRIOR}), 0) as pt from j),
r0 as (select *, case when trg_pos is not null and pt <= pa then 1 else 0 end as attempt,
    case when trg_pos is not null and pt > pa then 1 else 0 end as ignored,
    case when acc_pos is not null or (kind = 'update' and open_before = 1) then 1 else 0 end as pub from l),
r1 as (select *, cast(sum(attempt) over (partition by instrument_id {UPTO}) as bigint) as session_id from r0),
r as (select *, case when pub = 1 then cast(sum(pub) over (partition by instrument_id, session_id {UPTO}) as bigint) end as gateway_seq,
    case when kind in ('snapshot','bad_snapshot') and open_before = 1 then 'duplicate_snapshot'
      when kind = 'snapshot' then 'accepted_snapshot' when kind = 'bad_snapshot' then 'rejected'
      when kind in ('update','bad_update') and open_before = 0 then 'pre_snapshot'
      when kind = 'bad_update' then 'rejected' when kind = 'update' then 'published' else kind end as disposition from r1)"""
