"""Personal data: regular expressions propose, checksums confirm, nearby context words adjust the score.

Everything is SQL functions on the text column: no Python runs on the executors and nothing is shuffled.
A kind's regular expression only runs on texts that pass its cheap gate. Places come from one split and
one extraction by the same pattern: a match starts after the pieces and matches before it.

Repetitions are possessive and, where a run of characters could be tried from each of its places, a match
must start at the run's head or where the match before ended. Both leave the matches as they are and keep
very long texts linear.

Defined results: null text counts as empty and has no spans; an empty table gives an empty result;
repeated rows are scanned each for itself; other columns are not touched. Offsets are code points, end
exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """``valid`` is a condition on ``x.hit``; ``score`` is where the score starts before the context."""

    name: str
    gate: str
    pattern: str
    valid: str
    score: float
    context: str


BASE = (
    Kind(
        "email",
        "contains(text, '@')",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
        0.7,
        "mail|contact|write to|reach",
    ),
    Kind(
        "ip",
        r"rlike(text, r'[0-9]\.[0-9]++\.')",
        r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        rf"rlike(x.hit, r'^{_OCTET}(?:\.{_OCTET}){{3}}$')",
        0.6,
        "address|host|server|login|ip",
    ),
    Kind(
        "card",
        "rlike(text, r'[0-9](?:[ -]?[0-9]){15}')",
        r"[0-9](?:[ -]?[0-9])++",
        "char_length(regexp_replace(x.hit, '[ -]', '')) between 16 and 19 and luhn_check(regexp_replace(x.hit, '[ -]', ''))",
        0.8,
        "card|credit|visa|payment|account",
    ),
    Kind(
        "phone",
        "contains(text, '+')",
        r"\+[0-9][ ().0-9-]+[0-9]",
        "char_length(regexp_replace(x.hit, '[^0-9]', '')) between 8 and 15",
        0.6,
        "phone|call|tel|mobile|fax",
    ),
)

# Length of an account number by country, as the registry has them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES LY MD PK RO SA SE SK TN VG",
    25: "PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 33: "LC RU",
}


def iban_pattern() -> str:
    """An account number has its country's length, alone or with single blanks between its characters, in either case:
    a word behind it is not part of it."""
    forms = [f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}" for length, names in IBAN_LENGTHS.items()]
    return f"(?i)(?<![A-Z0-9])(?:{'|'.join(forms)})(?![A-Z0-9])"


# The remainder by 97 of the number that an IBAN spells once its first four characters stand at the end.
_IBAN = "upper(regexp_replace(x.hit, ' ', ''))"
_MOD_97 = f"""aggregate(split(concat(substr({_IBAN}, 5), substr({_IBAN}, 1, 4)), ''), 0, (r, c) -> case
    when c = '' then r when c between '0' and '9' then (r * 10 + cast(c as int)) % 97
    else (r * 100 + ascii(c) - 55) % 97 end)"""

EXTRA = (
    Kind(
        "iban",
        "rlike(text, '(?i)(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}')",
        iban_pattern(),
        f"{_MOD_97} = 1",
        0.8,
        "iban|bank|account|konto|transfer",
    ),
    Kind(
        "ssn",
        "rlike(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}')",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "true",
        0.3,
        "ssn|social security|taxpayer",
    ),
)
KINDS = BASE + EXTRA
CONTEXT_BEFORE, CONTEXT_AFTER, CONTEXT_GAIN = 40, 20, 0.2
#: Kinds of the method need this score; base spans stay whatever their score.
LEAST_SCORE = 0.5

_SPAN = "array<struct<start:int,stop:int,hit:string>>"


#: Steps that are summed in one go; the sums of these runs are summed in turn.
RUN = 512


def positions(steps: str, first: str, advance: str, build: str, kind: str) -> str:
    """SQL for ``build`` (of a step ``s`` and the place ``at`` where it begins) over an array of steps, each of which
    moves the place by ``advance``. Lists only grow within runs of ``RUN`` steps, so a text with very many
    hits takes a time about in proportion."""
    none = f"cast(array() as array<{kind}>)"
    runs = f"transform(sequence(0, greatest(cast(ceil(size(steps) / {RUN}) as int), 1) - 1), i -> slice(steps, i * {RUN} + 1, {RUN}))"
    lengths = f"transform(runs, r -> aggregate(r, 0, (total, s) -> total + {advance}))"
    starts = f"""aggregate({lengths}, named_struct('at', {first}, 'all', cast(array() as array<int>)),
      (acc, n) -> named_struct('at', acc.at + n, 'all', concat(acc.all, array(acc.at))), acc -> acc.all)"""
    inside = f"""zip_with(runs, {starts}, (r, begin) -> aggregate(r, named_struct('at', begin, 'found', {none}),
      (acc, s) -> named_struct('at', acc.at + {advance}, 'found', concat(acc.found, array({build.replace('{at}', 'acc.at')}))), acc -> acc.found))"""
    return f"flatten(flatten(transform(array({steps}), steps -> flatten(transform(array({runs}), runs -> {inside})))))"


def places(text: str, pattern: str) -> str:
    """SQL for the non-overlapping matches of ``pattern``, from the left, as (start, stop, hit)."""
    pieces = f"split({text}, r'{pattern}')"
    hits = f"regexp_extract_all({text}, r'{pattern}', 0)"
    steps = f"filter(zip_with({hits}, {pieces}, (h, p) -> struct(h as hit, char_length(p) as gap)), s -> s.hit is not null)"
    build = "named_struct('start', {at} + s.gap, 'stop', {at} + s.gap + char_length(s.hit), 'hit', s.hit)"
    return positions(steps, "0", "s.gap + char_length(s.hit)", build, "struct<start:int,stop:int,hit:string>")


def _spans(kind: Kind) -> str:
    found = f"case when {kind.gate} then {places('text', kind.pattern)} else cast(array() as {_SPAN}) end"
    return f"filter({found}, x -> {kind.valid})"


PIECE = 1024


def _scored(kind: Kind) -> str:
    """The spans with their scores; the neighbourhood comes from pieces of ``PIECE`` characters, not from the whole text."""
    first = f"greatest(x.start - {CONTEXT_BEFORE}, 0)"
    before = f"""substring(concat(get(_pieces, cast({first} div {PIECE} as int)), coalesce(get(_pieces, cast({first} div {PIECE} as int) + 1), '')),
        {first} % {PIECE} + 1, x.start - {first})"""
    after = f"""substring(concat(coalesce(get(_pieces, cast(x.stop div {PIECE} as int)), ''), coalesce(get(_pieces, cast(x.stop div {PIECE} as int) + 1), '')),
        x.stop % {PIECE} + 1, {CONTEXT_AFTER})"""
    near = f"lower(concat({before}, ' ', {after}))"
    score = f"least(1.0D, {kind.score}D + case when rlike({near}, r'\\b(?:{kind.context})') then {CONTEXT_GAIN}D else 0.0D end)"
    return f"""transform(`_{kind.name}`, x -> named_struct('kind', '{kind.name}', 'start', x.start, 'stop', x.stop,
        'hit', x.hit, 'score', {score}))"""


def find_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``found``: all spans (kind, start, stop, hit, score), by kind as listed, then start."""
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.selectExpr(*keep, "text", *[f"{_spans(kind)} as `_{kind.name}`" for kind in KINDS])
    some = " + ".join(f"size(`_{kind.name}`)" for kind in KINDS)
    cut = f"case when {some} > 0 then regexp_extract_all(text, r'(?s).{{1,{PIECE}}}', 0) else cast(array() as array<string>) end"
    rows = rows.withColumn("_pieces", F.expr(cut))
    parts = [_scored(kind) for kind in BASE]
    parts += [f"filter({_scored(kind)}, x -> x.score >= {LEAST_SCORE})" for kind in EXTRA]
    return rows.selectExpr(*keep, f"concat({', '.join(parts)}) as found")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the base spans and all spans as text."""
    listed = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"
    base = f"filter(found, x -> x.kind in ({', '.join(repr(k.name) for k in BASE)}))"
    counts = [f"cast(size(filter(found, x -> x.kind = '{k.name}')) as bigint) as n_{k.name}" for k in KINDS]
    return found.selectExpr(
        "doc_id",
        *counts[: len(BASE)],
        f"sha2({listed.format(base)}, 256) as base_sha256",
        f"{listed.format('found')} as spans",
        *counts[len(BASE) :],
        "coalesce(array_max(transform(found, x -> x.score)), 0.0D) as top_score",
    )
