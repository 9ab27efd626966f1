"""Personal data, licenses, quality rules."""

import re
import time

import numpy as np
import pytest
from llm import brute
from llm.conftest import LONG, ODD_ROWS

from feedlake.llm import licenses, pii, quality
from feedlake.llm.queries import QUERIES

TRICKY = [
    "a@b.c_d@e.f x@y.z.w a@b@c.d é@x.y z@ä.b me@x me@x..y",
    "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255 256.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559 4111111111111111 4111111111111111 1",
    "+1 (743) 555-3824 +123 +49 (0) 30 - 1234567. +12345678901234567890 ++1 2 3 4 5 6 7 8",
    "x" * 60000 + "@b.com",
    "1" * 30000,
    "1.2." * 3000,
    "a.b@" * 2000,
    "mail me@example.com or 10.0.0.1 " * 300,
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_private_spans_match_plain_regexes(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op2_personal_data"](spark, sf).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.private(texts[r.doc_id])


def test_private_spans_on_tricky_texts(spark):
    for r in pii.digest(pii.find_spans(rows(spark, TRICKY))).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.private(TRICKY[r.doc_id])


def test_method_kinds_need_checksum_or_context(spark):
    texts = [
        "iban DE89370400440532013000 and GB82 WEST 1234 5698 7654 32",
        "iban DE89370400440532013001",
        "ssn 078-05-1120",
        "part number 078-05-1120",
    ]
    got = {r.doc_id: (r.n_iban, r.n_ssn) for r in pii.digest(pii.find_spans(rows(spark, texts))).collect()}
    assert got == {0: (2, 0), 1: (0, 0), 2: (0, 1), 3: (0, 0)}
    found = pii.find_spans(rows(spark, ["call me: +1 743 555 3824", "x +1 743 555 3824"])).collect()
    assert found[0].found[0].score > found[1].found[0].score


def test_account_numbers_end_where_their_country_says(spark):
    """A word behind the number is not part of it; blanks and lower case do not hide it."""
    good = ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874",
            "SE45 5000 0000 0583 9825 7466", "DE89370400440532013000", "gb82 west 1234 5698 7654 32", "NO9386011117947"]
    texts = [f"x {g} {after} y" for g in good for after in ("BIC", "EUR", "VIA", "IBAN", "1234", "")]
    texts += [f"{g}{after}" for g in good for after in ("A", "9")] + [g[:-1] + str((int(g[-1]) + 1) % 10) for g in good]
    found = {r.doc_id: r for r in pii.find_spans(rows(spark, texts)).collect()}
    for i, text in enumerate(texts):
        hits = [f.hit for f in found[i].found if f.kind == "iban"]
        assert hits == ([good[i // 6]] if i < 6 * len(good) else []), text


def test_a_text_with_very_many_hits(spark):
    """Starts are running sums over runs of hits: 160 000 addresses take seconds, not hours."""
    text = " ".join(f"a{i}@b{i % 7}.org" for i in range(160_000)) + " contact \U0001f600 z@y.xx " + "cc by " * 3000
    begin = time.time()
    (row,) = pii.digest(pii.find_spans(rows(spark, [text]))).collect()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256) == brute.private(text)
    assert time.time() - begin < 60
    (row,) = licenses.digest(licenses.scan(rows(spark, [text]))).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == brute.licenses(text)


def test_license_places_match_plain_search(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op6_license_scan"](spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(texts[r.doc_id])
        assert 0 <= r.score <= 1


def test_license_rules_suppress_what_they_contain(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0",
        "GNU General Public License v3 or any later version",
        "CC_BY-SA 4.0 and cc by; CC  BY",
        "SPDX-License-Identifier: MPL-2.0",
        "mit license mit\nlicense MIT-License",
        "dual: BSD 3-Clause License or GPL 2.0",
        "KK licenﬁ İ CC BY " + "word " * 5000,
    ]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(rows(spark, texts))).collect()}
    labels = {i: r.labels for i, r in got.items()}
    assert labels[0] == "apache,apache-2.0"
    assert labels[1] == "gpl,gpl-3.0-or-later"
    assert labels[2] == "cc-by,cc-by-sa-4.0"
    assert labels[3] == "mpl-2.0"
    assert labels[5] == "bsd-3-clause,gpl-2.0"
    for i, r in got.items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(texts[i])
    assert len(licenses.RULES) > 300


def sample(parsed, full):
    """One text of a parsed pattern: with every optional part and the last branch, or with the least."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            out += chr(arg[0][1])
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "BRANCH":
            out += sample(arg[1][-1 if full else 0], full)
        elif name == "SUBPATTERN":
            out += sample(arg[3], full)
        elif name == "MAX_REPEAT":
            out += sample(arg[2], full) * (min(int(arg[1]), 16) if full else arg[0])
        else:
            assert name == "ASSERT_NOT"
    return out


def test_every_license_rule_passes_its_gate(spark):
    texts = []
    for rule in licenses.RULES:
        for full in (False, True):
            words = sample(re._parser.parse(rule.pattern), full)
            texts += [words, f"xx,\t{words.upper()}\n", words.replace(" ", "\r\n"), words.replace(" ", "  ")]
    got = licenses.scan(rows(spark, texts)).selectExpr("doc_id", "size(detections) as n").collect()
    assert [texts[r.doc_id] for r in got if r.n == 0] == []


def test_license_names_with_joined_versions_and_license_texts(spark):
    texts = {
        "Released under Apache 2.0.": "apache-2.0",
        "the terms of the Apache-2.0": "apache-2.0",
        "Creative\r\nCommons  Attribution": "cc-by",
        "MS--PL": "ms-pl",
        "GPLv3": "gpl-3.0",
        "LGPLv2.1": "lgpl-2.1",
        "MPLv2": "mpl-2.0",
        "AGPLv3 or later": "agpl-3.0-or-later",
        "gpl v 2.0": "gpl-2.0",
        "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal': "mit",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that": "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.": "0bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software": "bsd-3-clause",
        "The origin of this software must not be misrepresented": "zlib",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS': "apache-2.0",
        "permission to use the hall; redistribution and use of bottles; gplx, apaches, accby, lgpler": "",
    }
    got = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(rows(spark, list(texts)))).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == texts


def test_quality_counts_match_plain_python(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op8_quality_rules"](spark, sf).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute.quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_rejects_junk_and_keeps_clean(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [r for r in QUERIES["op8_quality_rules"](spark, sf).collect() if not r.base_failed]
    clean = [r.kept for r in judged if labels.get(r.doc_id) == 1]
    junk = [r.kept for r in judged if labels.get(r.doc_id) == 0]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(junk) <= 0.6 * len(junk)


RUSSIAN = "мы шли домой по тихой улице когда вечер уже опускался над городом и в окнах зажигались первые огни".split()
SERBIAN = "pored stare reke stoji mala kuća u kojoj živi moj deda sa svojim psom dok vetar nosi lišće preko polja".split()
SERBIAN_CYRILLIC = "поред старе реке стоји мала кућа у којој живи мој деда са својим псом док ветар носи лишће преко поља".split()


def prose(words, seed, n=90):
    random = np.random.default_rng(seed)
    return " ".join(random.permutation(words * (n // len(words) + 1))[:n]) + "."


def test_quality_keeps_clean_texts_of_any_language(spark, docs):
    fresh = {
        "ru": [prose(RUSSIAN, i) for i in range(40)],
        "sr": [prose(SERBIAN, i) for i in range(40)] + [prose(SERBIAN_CYRILLIC, i) for i in range(40)],
        "uk": [prose(RUSSIAN, 100 + i) for i in range(3)],  # too few for a reference
        "und": [prose(RUSSIAN, 200), prose(SERBIAN, 201)],
        None: [prose(RUSSIAN, 300)],
    }
    texts = [(i, lang, t) for i, (lang, t) in enumerate((lang, t) for lang, found in fresh.items() for t in found)]
    junk = [(1000, "ru", "#$% " * 10 + " ".join(f"{i}#|{i * 7}*" for i in range(80)))]
    table = spark.createDataFrame(texts + junk, "doc_id long, lang string, text string")
    table = table.unionByName(docs.selectExpr("doc_id + 10000 as doc_id", "lang", "text"))
    got = {r.doc_id: r for r in quality.judge(table).where("doc_id < 10000").collect()}
    assert [(i, lang) for i, lang, _ in texts if not got[i].kept] == []
    assert not got[1000].base_failed and not got[1000].kept
    assert {got[i].class_distance for i, lang, _ in texts if lang in ("uk", "und", None)} == {0.0}
    assert all(got[i].class_distance > 0 for i, lang, _ in texts if lang in ("ru", "sr"))


@pytest.mark.parametrize("run", [pii.find_spans, licenses.scan], ids=["pii", "licenses"])
def test_native_scans_take_odd_rows(run, odd, empty):
    assert run(odd).count() == len(ODD_ROWS)
    assert run(empty).count() == 0


def test_native_scans_define_odd_rows(odd):
    for r in licenses.digest(licenses.scan(odd)).collect():
        if r.doc_id in (2, 3, 4):
            assert (r.n_words, r.n_base, r.first_word, r.labels, r.score) == (0, 0, None, "", 0.0)
    for r in pii.digest(pii.find_spans(odd)).collect():
        assert r.spans == "" and r.base_sha256 == brute.private("")[4]


def test_quality_takes_odd_rows(odd, empty):
    judged = quality.judge(odd).collect()
    assert len(judged) == len(ODD_ROWS)
    assert all(not r.kept for r in judged if r.doc_id in (2, 3, 4))
    assert {r.n_words for r in judged if r.doc_id == 5} == {len(LONG.split())}
    assert quality.judge(empty).count() == 0
