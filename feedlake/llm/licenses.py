"""License scan: ordered signature rules on the words of a text, gated by keywords.

A text that passes one cheap gate is reduced to its words (A-Z lower-cased, runs of digits, letters and
non-ASCII characters) joined by blanks. The rules of a family run only where the family's keyword occurs.
Every rule has a priority; a detection inside the interval of another one goes if the other has a higher
priority, or the same one and a longer interval, or the same interval and an earlier rule. The base
phrases are counted apart and stay.

The rules are built from license families, their versions and the forms in which a license is named: a
bare name, a notice ("licensed under ..."), a tag and an address. ``SIGNATURES`` adds sentences of the license
texts themselves, for files that hold the text but not the name. The gate is built from the same names and
sentences. All of it is SQL functions: no Python
on the executors, no shuffle.

Defined results: null text counts as empty: no words, no labels, score 0, null positions; an empty table
gives an empty result; repeated rows are scanned each for itself; other columns are not touched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.pii import positions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Family:
    """A license with its names (a pattern over words), keywords of which every name has one, and versions."""

    label: str
    keyword: str
    names: str
    versions: tuple[str, ...] = ()
    later: bool = False


FAMILIES = (
    Family("gpl", "general public,gpl", "(?:gnu )?(?:general public licen[sc]e|gpl)", ("1", "2", "3"), True),
    Family("lgpl", "general public,lgpl", "(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)", ("2", "2.1", "3"), True),
    Family("agpl", "affero,agpl", "(?:gnu )?(?:affero general public licen[sc]e|agpl)", ("1", "3"), True),
    Family("fdl", "documentation,fdl,gfdl", "(?:gnu )?(?:free documentation licen[sc]e|gfdl|fdl)", ("1.1", "1.2", "1.3"), True),
    Family("apache", "apache", "apache(?: software)?(?: licen[sc]e)?", ("1", "1.1", "2")),
    Family("mpl", "mozilla,mpl", "(?:mozilla public licen[sc]e|mpl)", ("1", "1.1", "2")),
    Family("epl", "eclipse,epl", "(?:eclipse public licen[sc]e|epl)", ("1", "2")),
    Family("cddl", "distribution,cddl", "(?:common development and distribution licen[sc]e|cddl)", ("1", "1.1")),
    Family("eupl", "european,eupl", "(?:european union public licen[sc]e|eupl)", ("1", "1.1", "1.2")),
    Family("osl", "open software,osl", "(?:open software licen[sc]e|osl)", ("1", "2", "2.1", "3")),
    Family("afl", "academic,afl", "(?:academic free licen[sc]e|afl)", ("1.1", "1.2", "2", "2.1", "3")),
    Family("ofl", "open font,ofl", "(?:sil open font licen[sc]e|open font licen[sc]e|ofl)", ("1", "1.1")),
    Family("artistic", "artistic", "artistic licen[sc]e", ("1", "2")),
    Family("cecill", "cecill", "cecill(?: licen[sc]e)?", ("1", "2", "2.1")),
    Family("lppl", "latex,lppl", "(?:latex project public licen[sc]e|lppl)", ("1", "1.2", "1.3")),
    Family("bsl", "business,busl", "(?:business source licen[sc]e|busl)", ("1.1",)),
    Family("boost", "boost", "boost software licen[sc]e", ("1",)),
    Family("odbl", "database,odbl", "(?:open database licen[sc]e|odbl)", ("1",)),
    Family("psf", "python,psf", "(?:python software foundation licen[sc]e|psf licen[sc]e)", ("2",)),
    Family("php", "php", "php licen[sc]e", ("3", "3.01")),
    Family("zpl", "zope,zpl", "(?:zope public licen[sc]e|zpl)", ("1.1", "2", "2.1")),
    Family("ms-pl", "microsoft,ms pl", "(?:microsoft public licen[sc]e|ms pl)"),
    Family("ms-rl", "microsoft,ms rl", "(?:microsoft reciprocal licen[sc]e|ms rl)"),
    Family("cpl", "common public,cpl", "(?:common public licen[sc]e|cpl)", ("1",)),
    Family("ipl", "ibm", "ibm public licen[sc]e", ("1",)),
    Family("mit", "mit,expat", "(?:mit|expat)(?: x11)? licen[sc]e"),
    Family("isc", "isc", "isc licen[sc]e"),
    Family("zlib", "zlib", "zlib(?: libpng)? licen[sc]e"),
    Family("bsd-2-clause", "bsd,simplified,freebsd", "(?:bsd 2 clause(?: licen[sc]e)?|simplified bsd licen[sc]e|freebsd licen[sc]e)"),
    Family("bsd-3-clause", "bsd", "(?:bsd 3 clause(?: licen[sc]e)?|(?:new|modified|revised) bsd licen[sc]e)"),
    Family("bsd-4-clause", "bsd", "(?:bsd 4 clause(?: licen[sc]e)?|original bsd licen[sc]e)"),
    Family("bsd", "bsd", "bsd licen[sc]e"),
    Family("0bsd", "0bsd,zero clause", "(?:0bsd|zero clause bsd)(?: licen[sc]e)?"),
    Family("unlicense", "unlicense", "unlicense"),
    Family("wtfpl", "wtfpl", "wtfpl", ("1", "2")),
    Family("cc0", "cc0,zero,creativecommons", "(?:cc0|cc zero|creative ?commons zero)", ("1",)),
    Family("public-domain", "public domain", "public domain"),
    Family("all-rights-reserved", "all rights reserved", "all rights reserved"),
    *(
        Family(
            f"cc-{code}",
            "cc,commons,creativecommons",
            f"(?:cc|creative ?commons) (?:{code.replace('-', ' ')}|{names})(?: licen[sc]e)?",
            ("1", "2", "2.5", "3", "4"),
        )
        for code, names in (
            ("by", "attribution"),
            ("by-sa", "attribution share ?alike"),
            ("by-nd", "attribution no ?deriv(?:ative)?s?"),
            ("by-nc", "attribution non ?commercial"),
            ("by-nc-sa", "attribution non ?commercial share ?alike"),
            ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
        )
    ),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


def _version(text: str) -> str:
    """Words of a version: "2", "2 0", "version 2", "v2", "v 2 0", or written into the word before ("gplv2",
    "gpl2"); "2.1" stands as the words 2 and 1."""
    major, _, minor = text.partition(".")
    tail = f" {minor}" if minor else "(?: 0)?"
    return f"(?: licen[sc]e)?(?:(?: (?:version|ver))? (?:v(?:ersion)? ?)?|v?){major}{tail}"


# Sentences of license texts as (label, beginning of the sentence, how it goes on). The beginning is
# the keyword and passes the gate.
SIGNATURES = (
    ("mit", "permission is hereby granted", " free of charge to any person obtaining a copy of this software and associated documentation"),
    ("isc", "permission to use", " copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided"),
    ("0bsd", "permission to use", " copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd", "redistribution and use", " in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", "(?: [^ ]+){1,16} may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials", " mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "the origin of this software", " must not be misrepresented"),
    ("zlib", "altered source versions", " must be plainly marked as such"),
    ("apache-2.0", "unless required by applicable law", " or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2.0", "subject to the terms and conditions", " of this licen[sc]e each contributor hereby grants to you a perpetual worldwide"),
    ("unlicense", "this is free and unencumbered", " software released into the public domain"),
)


def build_rules() -> list[Rule]:
    """Rules in order, the first being the strongest among equals.

    Priorities: 4 notice with version, 3 tag or address or version named, 2 notice or sentence of a license
    text, 1 bare name.
    """
    rules: list[Rule] = []
    notice = "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?"
    for f in FAMILIES:
        words = f.label.replace("-", " ")
        rules.append(Rule(f.label, f.keyword, f"{notice}{f.names}", 2, 0.9))
        rules.append(Rule(f.label, f.keyword, f.names, 1, 0.6))
        rules.append(Rule(f.label, "spdx", f"spdx license identifier {words}", 3, 1.0))
        rules.append(Rule(f.label, "licenses", f"(?:org|com) licenses (?:{words})", 3, 0.9))
        for v in f.versions:
            number = v if "." in v else f"{v}.0"
            named, spaced = f"{f.label}-{number}", number.replace(".", " ")
            rules.append(Rule(named, f.keyword, f"{notice}{f.names}{_version(v)}", 4, 1.0))
            rules.append(Rule(named, f.keyword, f"{f.names}{_version(v)}", 3, 0.8))
            rules.append(Rule(named, "spdx", f"spdx license identifier {words} {spaced}(?: only)?", 4, 1.0))
            rules.append(Rule(named, "licenses", f"(?:org|com) licenses (?:{words}) {spaced}", 4, 1.0))
            if f.later:
                later = "(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later(?: version)?"
                rules.append(Rule(f"{named}-or-later", f.keyword, f"{notice}{f.names}{_version(v)}{later}", 5, 1.0))
                rules.append(Rule(f"{named}-or-later", f.keyword, f"{f.names}{_version(v)}{later}", 5, 0.9))
    rules += [Rule(label, start, f"{start}{rest}", 2, 0.9) for label, start, rest in SIGNATURES]
    return rules


def spellings(names: str) -> list[str]:
    """All texts that a pattern of names stands for."""
    group = re.search(r"\(\?:([^()]*)\)(\??)", names)
    if group:
        options = group[1].split("|") + [""] * len(group[2])
    elif group := re.search(r"\[([a-z]+)\]|(.)\?", names):
        options = list(group[1] or group[2]) + [""] * bool(group[2])
    else:
        return [names]
    return [text for option in options for text in spellings(names[: group.start()] + option + names[group.end() :])]


def build_gate() -> str:
    """Pattern over the raw text without which no rule and no base phrase can match.

    Every rule holds a name of its family, a tag, an address or the beginning of a sentence. Names with
    "license" in them need no alternative of their own, nor do those that hold another one. A blank stands
    for any gap; a name must end or go on with a version.
    """
    names = {text for f in FAMILIES for text in spellings(f.names)} | set(BASE)
    names = {n for n in names if not re.search("(?<![a-z0-9])licen[cs]", n)}
    names = {n for n in names if not any(f" {o} " in f" {n} " for o in names - {n})}
    phrases = ["licenc", "licens", "spdx", *(start for _, start, _ in SIGNATURES), *(f"{n}(?![a-uw-z])" for n in names)]
    firsts: dict[str, set[str]] = {}
    for phrase in phrases:
        firsts.setdefault(phrase[0], set()).add(phrase[1:].replace(" ", _GAP))
    branches = "|".join(f"{first}(?:{'|'.join(sorted(rest))})" for first, rest in sorted(firsts.items()))
    return rf"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?i:{branches})"


RULES = build_rules()
GATE = build_gate()
_HIT = "array<struct<start:int,stop:int,rank:int>>"


def _word_places(pattern: str) -> str:
    """SQL for word intervals of a pattern over ``_line`` (words, each between single blanks)."""
    cut = "concat('(?<= )(?:', {}, ')(?= )')".format(pattern)
    steps = f"""filter(zip_with(regexp_extract_all(_line, {cut}, 0), split(_line, {cut}),
        (h, p) -> struct(h as hit, char_length(regexp_replace(p, '[^ ]', '')) as gap)), s -> s.hit is not null)"""
    words = "char_length(regexp_replace(s.hit, '[^ ]', ''))"
    kind = "struct<start:int,stop:int>"
    build = f"named_struct('start', {{at}} + s.gap, 'stop', {{at}} + s.gap + {words} + 1)"
    found = positions(steps, "-1", f"s.gap + {words}", build, kind)
    return f"case when rlike(_line, {cut}) then {found} else cast(array() as array<{kind}>) end"


def _rule_table() -> str:
    """The rules as one literal array, grouped by keywords (beginnings of words)."""
    groups: dict[str, list[str]] = {}
    for rank, rule in enumerate(RULES):
        entry = f"named_struct('rank', {rank}, 'pattern', '{rule.pattern}')"
        groups.setdefault(rule.keyword, []).append(entry)
    return "array(" + ", ".join(f"named_struct('keywords', transform(split('{k}', ','), k -> concat(' ', k)), 'rules', array({', '.join(v)}))" for k, v in groups.items()) + ")"


def _pick(field: str, of: str) -> str:
    values = ", ".join(repr(getattr(rule, field)) + ("D" if field == "score" else "") for rule in RULES)
    return f"element_at(array({values}), {of} + 1)"


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_words``, the places of the base phrases (label, start) and the method's detections
    (label, start, stop, score) of every text, positions in words."""
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = rows.withColumns(
        {
            "n_words": (F.size(F.split(F.concat(F.lit(" "), "_text", F.lit(" ")), _GAP)) - 2).cast("long"),
            "_in": F.rlike("_text", F.lit(GATE)),
        }
    )
    line = f"case when _in then regexp_replace(concat(' ', translate(_text, '{UPPER}', '{LOWER}'), ' '), r'{_GAP}', ' ') end"
    rows = rows.withColumn("_line", F.expr(line)).drop("_text", "_in")
    base = [
        f"""transform(case when contains(_line, ' {phrase} ') then {_word_places(repr(phrase))} end,
            x -> named_struct('label', '{label}', 'start', x.start))"""
        for phrase, label in BASE.items()
    ]
    none = "cast(array() as array<struct<label:string,start:int>>)"
    base_places = "concat(" + ", ".join(f"coalesce({b}, {none})" for b in base) + ")"
    active = f"flatten(transform(filter({_rule_table()}, g -> exists(g.keywords, k -> contains(_line, k))), g -> g.rules))"
    hits = f"""flatten(transform({active}, r -> transform({_word_places('r.pattern')},
        x -> named_struct('start', x.start, 'stop', x.stop, 'rank', r.rank))))"""
    rows = rows.withColumns(
        {
            "base": F.expr(f"case when _line is null then {none} else {base_places} end"),
            "_hits": F.expr(f"case when _line is null then cast(array() as {_HIT}) else {hits} end"),
        }
    ).drop("_line")
    told = f"""transform(_hits, x -> named_struct('start', x.start, 'stop', x.stop, 'rank', x.rank,
        'priority', {_pick('priority', 'x.rank')}))"""
    rows = rows.withColumn("_hits", F.expr(f"case when size(_hits) > 0 then {told} end"))
    covered = """exists(_hits, y -> y.start <= x.start and y.stop >= x.stop and (y.priority > x.priority
        or (y.priority = x.priority and (y.stop - y.start > x.stop - x.start
          or (y.stop - y.start = x.stop - x.start and y.rank < x.rank)))))"""
    kept = f"""transform(filter(_hits, x -> not {covered}), x -> named_struct('label', {_pick('label', 'x.rank')},
        'start', x.start, 'stop', x.stop, 'score', {_pick('score', 'x.rank')}))"""
    empty = "cast(array() as array<struct<label:string,start:int,stop:int,score:double>>)"
    return rows.withColumn("detections", F.expr(f"coalesce({kept}, {empty})")).drop("_hits")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last base place, labels and score."""
    labels = "array_distinct(concat(transform(base, x -> x.label), transform(detections, x -> x.label)))"
    return scanned.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(base) as bigint) as n_base",
        "cast(array_min(transform(base, x -> x.start)) as bigint) as first_word",
        "cast(array_max(transform(base, x -> x.start)) as bigint) as last_word",
        "array_join(array_sort(array_distinct(transform(base, x -> x.label))), ',') as base_labels",
        f"array_join(array_sort({labels}), ',') as labels",
        "coalesce(array_max(transform(detections, x -> x.score)), case when size(base) > 0 then 0.5D else 0.0D end) as score",
        "cast(size(detections) as bigint) as n_detections",
    )
