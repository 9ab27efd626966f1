"""Language identification and toxicity: held-out accuracy and odd rows."""

import math
import zlib
from collections import Counter

from llm.conftest import ODD_ROWS
from pyspark.sql import functions as F

from feedlake.llm import langid, toxicity
from feedlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op5_language_id"](spark, SF).collect() if r.held_out]
    assert len(rows) > 150
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, empty, docs):
    model = langid.train(docs.where("lang is not null"))
    rows = langid.predict(odd, model, ["doc_id"]).collect()
    assert len(rows) == len(ODD_ROWS)
    for r in rows:
        if r.doc_id in (2, 3, 4, 8):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model[0]
    assert langid.predict(empty, model, ["doc_id"]).count() == 0
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}


def test_toxicity_learns_words_and_stems(spark):
    """Toxic words and stems of unseen forms in otherwise equal texts."""
    import numpy as np

    random = np.random.default_rng(3)
    filler = [f"{a}{b}" for a in ("tha", "ing", "ere", "ion", "ent", "oul", "ste") for b in ("n", "do", "mi", "ra", "le", "tus")]

    def text(bad, tail):
        words = list(random.choice(filler, int(random.integers(40, 120))))
        if bad:
            for spot in random.integers(0, len(words), 3):
                words[int(spot)] = str(random.choice(["skum", "vrekt"])) + str(random.choice(tail))
        return " ".join(words)

    train = [(text(i % 3 == 0, ["a", "en", "or", "is"]), int(i % 3 == 0)) for i in range(600)]
    net = toxicity.fit(train)
    fresh = [(text(i % 2 == 0, ["ul", "ax"]), int(i % 2 == 0)) for i in range(200)]
    block = toxicity._texts(fresh)
    said = net.text_logits(block) >= 0
    truth = np.array([label for _, label in fresh]) == 1
    assert said[truth].mean() > 0.9
    assert said[~truth].mean() < 0.05


def test_windows_cover_every_word():
    texts = toxicity._texts([("w " * n, 0) for n in (0, 1, 31, 32, 33, 56, 57, 200)])
    for row, n in enumerate((0, 1, 31, 32, 33, 56, 57, 200)):
        mine = texts.text == row
        covered = {p for a, b in zip(texts.start[mine], texts.stop[mine], strict=True) for p in range(a, b)}
        assert len(covered) == n


def test_toxicity_query_and_odd_rows(spark, odd, empty):
    rows = QUERIES["op7_toxicity"](spark, SF).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [r for r in rows if not r.held_out and r.doc_id in truth]
    assert len(rows) == 1000 and all(r.predicted == int(r.score >= 0.5) for r in rows)
    clean = [r.predicted for r in seen if truth[r.doc_id] == 0]
    assert sum(clean) < 0.15 * len(clean)
    net = toxicity.fit([("good words here", 0), ("bad words here", 1)] * 30)
    scored = toxicity.score(odd, net, ["doc_id"]).collect()
    assert len(scored) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in scored if r.doc_id in (2, 3, 4)} == {0.0}
    assert toxicity.score(empty, net, ["doc_id"]).count() == 0
    none = toxicity.train(odd, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert none is None
    assert toxicity.score(odd, None, ["doc_id"]).agg(F.max("score")).first()[0] == 0.0


def test_toxicity_of_held_out_documents(spark):
    """A network that has not seen the held-out part tells its labels; that part is the plain form's."""
    tables = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    rows = QUERIES["op7_toxicity"](spark, tables).select("doc_id", "held_out", "predicted").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [r for r in rows if r.held_out]
    toxic = [r.predicted for r in unseen if truth.get(r.doc_id) == 1]
    clean = [r.predicted for r in unseen if truth.get(r.doc_id) == 0]
    assert len(toxic) > 80 and sum(toxic) >= 0.82 * len(toxic)
    assert len(clean) > 600 and sum(clean) <= 0.04 * len(clean)


def test_language_equals_a_plain_form(spark):
    """Held-out rows, texts without letters, languages and scores against counting in dictionaries."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    wanted = {}

    def plain_grams(text):
        codes = [ord(c) if c.isalpha() else 32 for c in text.lower()]
        for width in (2, 3):
            for at in range(len(codes) - width + 1):
                if codes[at + width // 2] == 32:
                    continue
                key = 0
                for code in codes[at : at + width]:
                    key = (key * 0x100000001B3 + code) % 2**64
                yield (key * 0x9E3779B97F4A7C15) % 2**64 >> 49

    counts, sizes = {}, {}
    for r in docs:
        wanted[r.doc_id] = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        if not wanted[r.doc_id] and r.lang is not None:
            sizes[r.lang] = sizes.get(r.lang, 0) + 1
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text or ""))
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    texts = {r.doc_id: r.text for r in docs}
    for r in QUERIES["op5_language_id"](spark, "/root/testdata/sf0.001").collect():
        assert r.held_out == wanted[r.doc_id]
        text = texts[r.doc_id] or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        found = Counter(plain_grams(text))
        logs = {
            lang: math.log(sizes[lang] / sum(sizes.values()))
            + sum(n * math.log((c[g] + 0.5) / (totals[lang] + 0.5 * 2**15)) for g, n in found.items())
            for lang, c in sorted(counts.items())
        }
        best = max(logs, key=logs.get)
        score = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert abs(r.score - score) < 0.01
        assert r.lang_pred == best or score < 0.51
