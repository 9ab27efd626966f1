"""Source mix, sharding, and the pipeline."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from llm import brute
from llm.conftest import LONG, ODD_ROWS

from feedlake.llm import hilbert, mixing
from feedlake.llm.queries import QUERIES


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 10, "b": 1000, "c": 10, "d": 500},
        {"a": 0, "b": 7, None: 50},
        {"z": 5},
        {f"s{i}": (i * 37) % 101 for i in range(40)},
        {"a": 0, "b": 0},
    ],
)
def test_targets_match_repeated_capping(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, source_rows long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = brute.targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_walk_keeps_both_totals():
    random = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 2000):
        words, chance = random.integers(0, 500, n), np.full(n, 0.37)
        moved = mixing.walk(chance, words, random.random(n))
        assert ((moved > 0) & (moved < 1)).sum() <= 2
        assert abs(moved.sum() - chance.sum()) < 1e-6 and abs((moved * words).sum() - (chance * words).sum()) < 1e-4
        assert set(np.unique(mixing.land(moved, words))) <= {0.0, 1.0}


def test_mix_meets_its_targets(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    sizes = {r.doc_id: len(brute.words(r.text)) for r in docs.collect()}
    by_source = defaultdict(list)
    for r in rows:
        assert r.size == sizes[r.doc_id] and 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        by_source[r.source].append(r)
    want = brute.targets({s: sum(r.size for r in each) for s, each in by_source.items()})
    for s, each in by_source.items():
        assert abs(each[0].target - want[s]) < 1e-6 * want[s]
        # The landing leaves half of one document's words at most.
        assert abs(sum(r.taken for r in each) - want[s]) <= max(r.size for r in each)
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mix_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [(i, "w " * (1 + i * 7 % 40), "big" if i % 3 else f"s{i % 4}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 900
    for s in {r.source for r in got}:
        each = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in each) - each[0].target) <= 40
        rate = each[0].target / each[0].source_size
        assert abs(sum(r.copies for r in each) - rate * len(each)) <= 2


def test_mix_takes_odd_rows(odd, empty):
    mixed = mixing.mix_sources(odd)
    assert mixed.count() == len(ODD_ROWS)
    taken = mixing.materialise(odd, mixed)
    assert taken.columns == odd.columns
    want = sum(r.copies for r in mixed.collect())
    assert taken.count() == want
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.materialise(empty, mixing.mix_sources(empty)).count() == 0


def test_curve_visits_every_cell_by_single_steps():
    for bits, dims in ((2, 2), (3, 3), (2, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = hilbert.curve_index(cells, bits)
        assert sorted(order) == list(range(side**dims))
        path = cells[np.argsort(order)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_gapless(spark, sf, docs):
    import zlib

    rows = QUERIES["op9_hilbert_shards"](spark, sf).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r)
    assert sorted(slots) == list(range(8))
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1
    for each in slots.values():
        assert sorted(r.slot for r in each) == list(range(len(each)))
        in_order = sorted(each, key=lambda r: r.slot)
        assert all(a.curve <= b.curve for a, b in zip(in_order, in_order[1:], strict=False))
    places = defaultdict(list)
    for r in rows:
        places[texts[r.doc_id]].append(r.curve)
    assert all(len(set(c)) == 1 for c in places.values())


def test_shards_of_odd_rows_and_files(spark, odd, empty, tmp_path):
    rows = hilbert.sharded(odd, 3)
    assert rows.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    assert sorted(Counter(r.shard for r in rows.collect()).values()) == [3, 3, 4]
    hilbert.write_shards(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD_ROWS)
    assert hilbert.sharded(empty).count() == 0
    few = hilbert.sharded(odd.limit(2), 8).collect()
    assert len(few) == 2 and len({r.shard for r in few}) == 2


def test_pipeline_stages_match_brute_force(spark, sf, docs):
    """Every stage against what its own input asks for."""
    rows = docs
    before = {r.doc_id: r.text for r in rows.collect()}
    steps = dict(corpus_pipeline.STAGES)
    rows = steps["quality rules"](spark, rows, sf).cache()
    kept = {r.doc_id: r.text for r in rows.collect()}
    assert rows.columns == docs.columns
    assert all(not brute.quality(t)[5] for t in kept.values())
    assert len(kept) > 0.6 * sum(not brute.quality(t)[5] for t in before.values())

    rows = steps["near-duplicates"](spark, rows, sf).cache()
    groups = brute.components(kept)
    assert sorted(r.doc_id for r in rows.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)

    held = {r.doc_id: r.text for r in rows.collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = steps["benchmark decontamination"](spark, rows, sf).cache()
    bad = {d for d, _ in brute.leaks(held, items)}
    assert sorted(r.doc_id for r in rows.collect()) == sorted(set(held) - bad)

    mixed = steps["source mix"](spark, rows, sf).cache()
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    final = steps["hilbert shards"](spark, mixed, sf)
    assert final.count() == mixed.count() and final.columns == [*docs.columns, "shard", "slot"]


def test_pipeline_runs_whole(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    counts = Counter(r.shard for r in rows.collect())
    assert sorted(counts) == list(range(8)) and max(counts.values()) - min(counts.values()) <= 1


def test_pipeline_takes_empty_and_odd_tables(spark, odd, empty, sf):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() >= 0
    assert len(LONG) > 100000
