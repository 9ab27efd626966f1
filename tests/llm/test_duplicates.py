"""Near-duplicates, exact repeats, decontamination."""

import numpy as np
import pytest
from llm import brute
from llm.conftest import ODD_ROWS

from feedlake.llm import components, decontamination, repeats, superminhash
from feedlake.llm.queries import QUERIES


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def edited(seed, base, share):
    random = np.random.default_rng(seed)
    return " ".join(w if random.random() > share else f"e{seed}x{i}" for i, w in enumerate(base))


def test_components_match_all_pairs(spark, sf, docs):
    want = brute.components({r.doc_id: r.text for r in docs.collect()})
    for r in QUERIES["op10_superminhash"](spark, sf).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_large_group_near_the_limit_loses_no_link(spark):
    """One large bucket, with pairs on both sides of 75 percent, and tiny texts."""
    base = [f"w{i}" for i in range(160)]
    texts = [edited(n, base, 0.02 + 0.02 * (n % 3)) for n in range(150)]
    texts += ["one", "one", "one two", "a b c d e", "A B C D E", "a b c d", ""]
    want = brute.components(dict(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) > 3


def test_common_keys_are_counted_exactly(monkeypatch):
    random = np.random.default_rng(5)
    monkeypatch.setattr(superminhash, "_COLUMNS", 16)
    sets = [np.unique(random.integers(0, 400, int(random.integers(0, 300)))).astype(np.uint64) for _ in range(30)]
    owner = np.repeat(np.arange(30), [len(s) for s in sets])
    got = superminhash.common(np.concatenate(sets), owner, 30)
    for a in range(30):
        for b in range(30):
            if a != b:
                assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_tiles_of_a_large_group_change_nothing(spark, monkeypatch):
    base = [f"w{i}" for i in range(160)]
    texts = [edited(n, base, 0.02 + 0.02 * (n % 3)) for n in range(90)]
    monkeypatch.setattr(superminhash, "TILE", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute.components(dict(enumerate(texts)))


def test_equal_ids_with_different_texts(spark):
    """Each text links by its own words, whatever the other rows of its id say."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = spark.createDataFrame([(1, a), (1, b), (2, b + " word"), (3, a + " word"), (3, a + " word"), (None, a)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in superminhash.near_duplicates(rows).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (None, 1)], key=str)
    kept = sorted((r.doc_id, r.text) for r in superminhash.without_duplicates(rows.where("doc_id is not null")).collect())
    assert kept == [(1, a), (1, b)]
    unrelated = spark.createDataFrame([(5, a), (5, b), (5, b), (7, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in superminhash.without_duplicates(unrelated).collect()) == [(5, a), (5, b)]


def test_superminhash_estimates_similarity():
    keys = superminhash.mix(np.arange(3000, dtype=np.uint64))
    rows = np.concatenate([np.zeros(2000, np.int64), np.ones(2000, np.int64)])
    values = superminhash.signatures(np.concatenate([keys[:2000], keys[1000:]]), rows, 2)
    assert abs((values[0] == values[1]).mean() - 1 / 3) < 0.13
    again = superminhash.signatures(keys[:2000], np.zeros(2000, np.int64), 1)
    assert (again[0] == values[0]).all()
    few = superminhash.signatures(keys[:3], np.zeros(3, np.int64), 1)[0]
    assert (few != np.iinfo(np.uint64).max).all()


def test_one_row_per_group_stays(spark, odd, empty):
    kept = superminhash.without_duplicates(odd).collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 5, 7, 8]
    assert sum(r.doc_id is None for r in kept) == 1
    assert set(kept[0].asDict()) == set(odd.columns)
    assert superminhash.without_duplicates(empty).count() == 0
    assert superminhash.near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def check_repeats(spark, texts):
    found = sorted(repeats.find_repeats(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found]
    assert got == brute.repeats(texts)
    for r in found:
        assert sum(run.stop - run.start for run in r.runs) == r.n_removed


def test_repeats_match_window_counts(spark, sf, docs):
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], brute.repeats([r.text for r in rows]), strict=True))
    for r in QUERIES["op3_repeated_passages"](spark, sf).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


@pytest.mark.parametrize("seed", range(4))
def test_repeats_at_every_offset(spark, seed):
    """Shared passages of 190 to 260 bytes at random places, periodic texts, multi-byte characters."""
    random = np.random.default_rng(seed)

    def noise(n):
        return "".join(chr(97 + c) for c in random.integers(0, 26, n))

    passages = [noise(n) for n in (190, 199, 200, 201, 215, 230, 260, 600)]
    texts = []
    for _ in range(40):
        parts = [noise(int(random.integers(0, 400)))]
        for p in random.permutation(passages)[:3]:
            cut = int(random.integers(0, 40))
            parts += [str(p)[cut:] if random.random() < 0.5 else str(p)[: len(p) - cut], noise(int(random.integers(0, 150)))]
        texts.append("".join(parts))
    texts += ["ab" * 300, "ab" * 150, "x" * 200, "x" * 199, "x" * 201, "é" * 150, "é" * 99, "", "ü" + "a" * 198]
    check_repeats(spark, texts)


def test_repeats_take_odd_rows(odd, empty):
    found = repeats.find_repeats(odd).collect()
    assert len(found) == len(ODD_ROWS)
    assert all(r.n_removed == r.n_bytes for r in found if r.doc_id in (5, 6))
    assert all(r.n_removed == 0 for r in found if r.doc_id not in (5, 6))
    assert repeats.find_repeats(empty).count() == 0


def test_leaks_match_all_pairs(spark, sf, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_benchmark_leaks"](spark, sf).collect()}
    assert got == brute.leaks({r.doc_id: r.text for r in docs.collect()}, items)


def test_leaks_at_the_limit_and_short_items(spark):
    item = " ".join(f"q{i}" for i in range(24))  # 20 shingles, 15 of them are enough
    texts = {
        0: "lead " + " ".join(f"q{i}" for i in range(19)) + " tail",
        1: "lead " + " ".join(f"q{i}" for i in range(18)) + " tail",
        2: "filler " * 20000 + item.upper(),
        3: "two Words",
        4: "two words more",
        5: None,
        6: "",
    }
    items = {0: item, 1: "two words", 2: None, 3: "", 4: item, 5: "a b c d e"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(rows, asked).collect()}
    assert got == brute.leaks(texts, items) == {(0, 0), (0, 4), (2, 0), (2, 4), (3, 1)}
    small, decontamination.BROADCAST_ROWS = decontamination.BROADCAST_ROWS, 0
    try:
        assert {(r.doc_id, r.item_id) for r in decontamination.leaks(rows, asked).collect()} == got
    finally:
        decontamination.BROADCAST_ROWS = small


def test_leaks_take_odd_rows(spark, odd, empty, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontamination.without_leaks(odd, items).count() == len(ODD_ROWS)
    assert decontamination.leaks(empty, items).count() == 0
    assert decontamination.leaks(odd, items.limit(0)).count() == 0
