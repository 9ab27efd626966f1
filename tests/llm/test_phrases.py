"""Phrase collocations against plain counts, the SQL form and themselves under other budgets."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm import brute
from llm.conftest import ODD_ROWS

from feedlake.llm import phrases
from feedlake.llm.queries import QUERIES, SQL


def plain(rows, top=2000):
    """rows of (text, lang) -> rows of the contract, by counting every phrase of up to three words."""
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.ASCII_LOWER)):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(found)
            f = counts.setdefault(lang, Counter())
            for i in range(len(found)):
                for n in (1, 2, 3):
                    if i + n <= len(found):
                        f[tuple(found[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        kept = []
        for p, a in candidates.items():
            longer = [q for q in candidates if len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:])] if len(candidates) < 3000 else None
            if longer is None:
                raise AssertionError("too many for a plain check")
            if any(100 * candidates[q] >= 50 * a for q in longer):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def sample(seed=3, size=400):
    """Few words, many repeats, pieces, wide characters and a piece that fills a third of all texts."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "Ab", "\x00x", "a|b", "\U0001f600"]
    rows = []
    for _ in range(size):
        parts = []
        for _ in range(draw.randint(0, 25)):
            parts.append(draw.choices(vocabulary, weights=[1 + (i < 5) * 6 for i in range(len(vocabulary))])[0])
            parts.append(draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ; "]))
        text = "".join(parts)
        if draw.random() < 0.33:
            text += ". hot hot hot pair of words again"
        rows.append((text, draw.choice(["en", "en", "de", None, "und", ""])))
    return rows


def test_matches_plain_counts(spark):
    rows = sample()
    got = result(phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(5)))
    assert got == plain(rows) and len({r[0] for r in got}) == 4


def test_extended_cells_and_small_folds_change_nothing(spark, monkeypatch):
    """A budget that the common prefixes exceed: their nodes lie in several groups."""
    rows = sample(seed=8)
    plan = phrases.pack
    seen = []
    monkeypatch.setattr(phrases, "pack", lambda loads, budget: seen.append(plan(loads, 40)) or seen[-1])
    got = result(phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(5)))
    assert got == plain(rows)
    assert (seen[0][1] > 1).any()


def test_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    cursor = con.execute(SQL["op12_phrases"])
    at = [[c[0] for c in cursor.description].index(n) for n in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    want = sorted(tuple(row[i] for i in at) for row in cursor.fetchall())
    assert result(QUERIES["op12_phrases"](spark, sf)) == want and want


def test_top_is_cut_after_ranking(spark):
    rows = sample(seed=5)
    got = result(phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), top=3))
    assert got == plain(rows, top=3)


def test_groups_hold_their_budget():
    loads = np.array([5, 0, 3, 2, 40, 1, 9, 10, 11, 0, 4])
    first, parts = phrases.pack(loads, 10)
    held = Counter()
    for cell, load in enumerate(loads.tolist()):
        for k in range(parts[cell]):
            held[first[cell] + k] += load / parts[cell]
    assert max(held.values()) <= 10 and parts.tolist() == [1, 1, 1, 1, 4, 1, 1, 1, 2, 1, 1]
    groups = [range(f, f + p) for f, p in zip(first, parts, strict=True) if p > 1]
    singles = {f for f, p in zip(first.tolist(), parts.tolist(), strict=True) if p == 1}
    assert not any(g in span for g in singles for span in groups)


def test_names_under_another_attempt(spark):
    texts = spark.createDataFrame(sample(), "text string, lang string").selectExpr("lang", "xxhash64(lang) as lang_key", "text")
    one, two = ({(r.lang, r.word): (r.name, r.n) for r in phrases._counted(texts, a).groupBy("lang", "word", "name").sum("n")
                 .withColumnRenamed("sum(n)", "n").where("word is not null").collect()} for a in (0, 1))
    assert {k: n for k, (_, n) in one.items()} == {k: n for k, (_, n) in two.items()}
    assert all(one[k][0] != two[k][0] for k in one)


def test_odd_rows(spark, odd, empty):
    got = result(phrases.collocations(odd))
    assert got == plain([(r[1], r[2]) for r in ODD_ROWS])
    assert {r[0] for r in got} == {"en", "und"}
    assert phrases.collocations(empty).count() == 0


@pytest.mark.parametrize("count", [3_000_000_000, 4 * 10**15])
def test_scores_are_exact_beyond_64_bits(spark, count):
    row = spark.createDataFrame([(count, count + 7, 2 * count + 1)], "a long, l long, r long")
    got = row.selectExpr(phrases.SCORE.format(l="l", r="r")).first()[0]
    assert got == 1000000 * count * count // ((count + 7) * (2 * count + 1))
