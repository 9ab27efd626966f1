"""Term divergence against plain integer arithmetic, the SQL form and other chunk and block sizes."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
from llm import brute
from llm.conftest import ODD_ROWS

from feedlake.llm import divergence
from feedlake.llm.queries import QUERIES, SQL


def plain(rows, top=50, least=30):
    """rows of (text, lang, source) -> rows of the contract."""
    counts, seen, groups = {}, Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(brute.ASCII_LOWER))
        seen.update((lang, t) for t in set(found))
        counts.setdefault((lang, source), Counter()).update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (g, t), n in seen.items() if g == lang and n >= least]
        ours = {s: counts[lang, s] for g, s in groups if g == lang}

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: share(c) for s, c in ours.items()}
        q = share(sum(ours.values(), Counter()))
        for s in ours:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in ours if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if ours[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def sample(seed, size=500):
    draw = random.Random(seed)
    terms = [f"{a}{b}" for a in "abcdefgh" for b in "klmno"] + ["É", "é", "Ñandú", "\U0001f600x", "K"]
    rows = []
    for _ in range(size):
        source = draw.choice(["s1", "s2", "s3", "S1", "", None, "é", "\U0001f600", "only digits", *[f"many{i}" for i in range(30)]])
        text = "12 34 [] \x7f" if source == "only digits" else draw.choice([" ", "1", "_"]).join(draw.choices(terms, k=draw.randint(0, 30)))
        rows.append((None if draw.random() < 0.02 else text, draw.choice(["en", "en", "en", None, "", "xx"] + ["rare"] * (draw.random() < 0.1)), source))
    return rows


def test_matches_plain_arithmetic(spark):
    rows = sample(1)
    got = result(divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)))
    assert got == plain(rows)
    # A language whose terms are all too rare: its distances are 0 and still ranked.
    assert {r[4] for r in got if r[0] == "rare" and r[2] == "pair"} == {0}


def test_small_chunks_and_blocks_change_nothing(spark, monkeypatch):
    rows = sample(2)
    monkeypatch.setattr(divergence, "CHUNK", 7)
    monkeypatch.setattr(divergence, "BLOCK", 3)
    assert result(divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4))) == plain(rows)


def test_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    cursor = con.execute(SQL["op13_divergence"])
    at = [[c[0] for c in cursor.description].index(n) for n in ("lang", "source", "part", "item", "value", "rank")]
    want = sorted(tuple(row[i] for i in at) for row in cursor.fetchall())
    assert result(QUERIES["op13_divergence"](spark, sf)) == want
    assert {r[2] for r in want} == {"pair", "term"}


def test_sql_matches_plain_arithmetic():
    rows = sample(3)
    con = duckdb.connect()
    con.execute("create table documents (text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    cursor = con.execute(SQL["op13_divergence"])
    at = [[c[0] for c in cursor.description].index(n) for n in ("lang", "source", "part", "item", "value", "rank")]
    assert sorted(tuple(row[i] for i in at) for row in cursor.fetchall()) == plain(rows)


def test_shares_are_exact_for_huge_counts(spark):
    total, kept = 9 * 10**14, 123_457
    n = np.array([0, 1, 10**9, 10**13 + 7, total], np.int64)
    want = [1 + 10**9 * (int(x) + 5) // (total + 5 * kept) for x in n]
    assert divergence.shares(n, total, kept).tolist() == want
    rows = spark.createDataFrame([(int(x), total, kept) for x in n], "n long, total long, kept long")
    got = rows.select("n", divergence.share(rows["n"], "total").alias("p")).collect()
    assert [r.p for r in sorted(got, key=lambda r: r.n)] == want


def test_merge_prices_both_sides():
    draw = np.random.default_rng(5)
    for size in (0, 1, 40):
        a, b = (np.sort(draw.choice(100, k, replace=False)) for k in (size, 60))
        p, q = draw.integers(1, 1000, len(a)), draw.integers(1, 1000, len(b))
        left, right = dict(zip(a.tolist(), p.tolist(), strict=True)), dict(zip(b.tolist(), q.tolist(), strict=True))
        want = sum(abs(left.get(t, 3) - right.get(t, 4)) for t in left.keys() | right.keys())
        for x, y in (((a, p, 3), (b, q, 4)), ((b, q, 4), (a, p, 3))):
            assert divergence.price(x, y) == (want, len(left.keys() | right.keys()))


def test_odd_rows(spark, odd, empty):
    rows = [(r[1], r[2], r[3]) for r in ODD_ROWS]
    assert result(divergence.audit(odd)) == plain(rows)
    assert divergence.audit(empty).count() == 0
