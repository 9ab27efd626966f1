"""MinHash near-duplicates by SuperMinHash: correlated permutation ranks, banding, verification, union-find.

SuperMinHash gives every element one random permutation of the slots and, at step j, the value j + r in
the j-th slot of that permutation. Values of a slot stay uniform but the slots of one set are negatively
correlated, which lowers the variance; a text stops as soon as no slot can improve any more. Texts with
the same shingle set are one class, known by the set's fingerprint and not by an id, so exact copies never
meet in a band and equal ids with different texts stay apart.

Links: 100 * |A and B| >= 75 * |A or B| on the sets of distinct five-word shingles (A-Z lower-cased; words
are runs outside space and \\x09-\\x0D; fewer than five words: the whole sequence is the one shingle).
Every candidate is confirmed on the full sets. With 32 bands of 4 slots a link at exactly 0.75 is missed
with a probability of 5e-6, and less above; nothing else drops a pair but sizes that rule a link out.

No group is expanded into its pairs. In every bucket each class meets the bucket's smallest class, and of
the leaders that it meets the one with the most bands in common is confirmed; these links give a first set
of components. Only buckets that still hold several components are searched further, in tiles of at most
about twice ``TILE`` classes or ``TILE_SHINGLES`` shingles: a task counts the common shingles of all its classes at
once, exactly, and returns only links that join two components, fewer than it has components.

Defined results: null, empty and wordless texts have an empty set, are linked with nothing and are their
own component; rows with one id and different texts are judged each by its text; a null id takes part, and
its component is the smallest id of its class. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.components import components
from feedlake.llm.textblocks import U64, Block, blocks, map_blocks, mix, runs
from feedlake.session import fresh_path

SHINGLE = 5
SLOTS = 128
BAND_ROWS = 4
BANDS = SLOTS // BAND_ROWS
SIMILARITY = 75
TILE, TILE_SHINGLES = 256, 1 << 18
_COLUMNS = 4096
_GOLDEN = U64(0x9E3779B97F4A7C15)


def _multiple(k: int) -> np.uint64:
    return U64(k * int(_GOLDEN) % (1 << 64))


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block and their row numbers, ordered by row."""
    low = block.lowered()
    starts, ends = low.words()
    words = Block.span_hashes(low.prefix_hashes(), starts, ends)
    owner = block.owner(starts)
    count = np.bincount(owner, minlength=len(block))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    found, rows = [], []
    n = len(words) - SHINGLE + 1
    if n > 0:
        key = np.full(n, SHINGLE, U64)
        for step in range(SHINGLE):
            key = mix(key * _GOLDEN + words[step : step + n])
        inside = owner[:n] == owner[SHINGLE - 1 :]
        found.append(key[inside])
        rows.append(owner[:n][inside])
    for length in range(1, SHINGLE):
        short = np.flatnonzero(count == length)
        if len(short):
            key = np.full(len(short), length, U64)
            for step in range(length):
                key = mix(key * _GOLDEN + words[first[short] + step])
            found.append(key)
            rows.append(short)
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    keys, rows = np.concatenate(found), np.concatenate(rows)
    _, at = np.unique(mix(keys + rows.astype(U64) * _GOLDEN), return_index=True)
    at = at[np.argsort(rows[at], kind="stable")]
    return keys[at], rows[at]


def signatures(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """SuperMinHash values, one row of ``SLOTS`` integers per text; the step is in the top byte."""
    values = np.full(n * SLOTS, np.iinfo(np.uint64).max, U64)
    active, owner = keys, rows
    order = None
    for step in range(SLOTS):
        if not len(active):
            break
        draw = mix(active + _multiple(2 * step + 1))
        pick = step + (mix(draw) % U64(SLOTS - step)).astype(np.int64)
        if step == 0:
            slot = pick
        else:
            line = np.arange(len(active))
            slot = order[line, pick].astype(np.int64)
            order[line, pick] = order[:, step]
            order[:, step] = slot
        np.minimum.at(values, owner * SLOTS + slot, (draw >> U64(8)) | (U64(step) << U64(56)))
        # Early stop: no slot of a text is left that the next step could lower.
        worst = (values.reshape(n, SLOTS) >> U64(56)).max(axis=1)
        stay = worst[owner] > step
        if step == 0:
            order = np.tile(np.arange(SLOTS, dtype=np.uint8), (int(stay.sum()), 1))
            line, moved = np.arange(len(order)), pick[stay]
            order[line, moved] = 0
            order[:, 0] = moved
        else:
            order = order[stay]
        active, owner = active[stay], owner[stay]
    return values.reshape(n, SLOTS)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text_a and text_b (128-bit name of the text), n_shingles, print_a and print_b (of the shingle set), band keys."""

    def work(rows, block):
        n = len(block)
        keys, owner = shingles(block)
        counts = np.bincount(owner, minlength=n)
        prints = np.zeros((2, n), U64)
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        for half in range(2):
            if len(keys):
                prints[half, owner[heads]] = np.add.reduceat(mix(keys + _multiple(half + 7)), heads)
        values = mix(signatures(keys, owner, n))
        bands = np.arange(BANDS, dtype=U64)[None, :] * _GOLDEN
        grouped = values.reshape(n, BANDS, BAND_ROWS)
        for step in range(BAND_ROWS):
            bands = mix(bands + grouped[:, :, step])
        flat = pa.array(bands.view(np.int64).ravel())
        return {
            **{c: rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "text_a", "text_b")},
            "n_shingles": counts.astype(np.int64),
            "print_a": prints[0].view(np.int64),
            "print_b": prints[1].view(np.int64),
            "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), flat),
        }

    schema = "doc_id long, text_a long, text_b long, n_shingles long, print_a long, print_b long, bands array<long>"
    return map_blocks(docs.select(F.col("doc_id").cast("long"), *_text_name(docs["text"]), "text"), schema, work)


def _text_name(text) -> list:
    return [F.xxhash64(F.lit(i), text).alias(n) for i, n in enumerate(("text_a", "text_b"), 1)]


def _sets(texts: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` (longs) and the shingle hashes of the texts."""

    def work(rows, block):
        keys, owner = shingles(block)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(block)))]).astype(np.int64)
        held = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(keys.view(np.int64)))
        return {**{k: rows.column(rows.schema.get_field_index(k)) for k in keep}, "keys": held.cast(pa.list_(pa.int64()))}

    return map_blocks(texts.select(*keep, "text"), ", ".join(f"{k} long" for k in keep) + ", keys array<long>", work)


def common(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Matrix of the numbers of common keys of ``n`` sets: exact, by products of membership matrices."""
    _, column, times = np.unique(keys, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    inside = shared[column]
    column, owner = number[column[inside]], owner[inside]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), np.int64)
    for low in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, (low, low + _COLUMNS))
        member = np.zeros((n, _COLUMNS), np.float32)  # sums of at most _COLUMNS ones are exact
        member[owner[a:b], column[a:b] - low] = 1
        out += (member @ member.T).astype(np.int64)
    return out


def tile_links(keys: np.ndarray, owner: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the sets of one tile that are linked and join two components, which grow together on the way."""
    n, component = len(component), component.copy()
    sizes, both = np.bincount(owner, minlength=n), common(keys, owner, n)
    linked = (100 * both >= SIMILARITY * (sizes[:, None] + sizes[None, :] - both)) & (both > 0)
    x, y = np.nonzero(np.triu(linked, 1))
    found = []
    while True:
        apart = component[x] != component[y]
        x, y = x[apart], y[apart]
        if not len(x):
            return found
        found.append((int(x[0]), int(y[0])))
        component[component == component[y[0]]] = component[x[0]]


def _tiled(rows: DataFrame) -> DataFrame:
    """Links (x, y) in crowded buckets: ``rows`` are band, key, blocks, rep, component, keys."""
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = rows.select(
        "band", "key", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), "rep", "component", "keys"
    )
    tile = ["band", "key", "i", "j"]

    def search(batches):
        for run in runs(batches, tile):
            if run.num_rows < 2:
                continue
            held = run.column("keys").combine_chunks()
            count = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = held.flatten().to_numpy(zero_copy_only=False).view(U64)
            rep = run.column("rep").to_numpy()
            pairs = tile_links(keys, np.repeat(np.arange(len(rep)), count), run.column("component").to_numpy())
            if pairs:
                x, y = rep[np.array(pairs, np.int64).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])

    return tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(search, "x long, y long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (x, y) of classes whose full shingle sets are similar enough; ``texts`` are (rep, text)."""
    with_x = pairs.join(texts.select(F.col("rep").alias("x"), F.col("text").alias("text_x")), "x")
    both = with_x.join(texts.select(F.col("rep").alias("y"), F.col("text").alias("text_y")), "y")

    def compare(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("text_x", "text_y")]
            similar = np.zeros(batch.num_rows, bool)
            for at, to, block in blocks(columns[0]):
                n = to - at
                keys_x, rows_x = shingles(block)
                sizes = np.bincount(rows_x, minlength=n)
                shared = np.zeros(n, np.int64)
                for low, high, other in blocks(columns[1].slice(at, n)):
                    keys_y, rows_y = shingles(other)
                    rows_y = rows_y + low
                    sizes = sizes + np.bincount(rows_y, minlength=n)
                    mine = (rows_x >= low) & (rows_x < high)
                    keys = np.concatenate([keys_x[mine], keys_y])
                    owner = np.concatenate([rows_x[mine], rows_y])
                    _, first, times = np.unique(mix(keys + owner.astype(U64) * _GOLDEN), return_index=True, return_counts=True)
                    shared += np.bincount(owner[first[times > 1]], minlength=n)
                similar[at:to] = (100 * shared >= SIMILARITY * (sizes - shared)) & (shared > 0)
            found = pa.array(similar)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)).filter(found) for c in ("x", "y")], names=["x", "y"]
            )

    return both.mapInArrow(compare, "x long, y long")


def _fits(a: str, b: str):
    """Sizes that allow a link: the smaller set has at least 75 percent of the larger one."""
    return (100 * F.col(a) >= SIMILARITY * F.col(b)) & (100 * F.col(b) >= SIMILARITY * F.col(a))


def _classified(docs: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b, n_shingles, ``label`` of the component and its smallest id, of every row."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "superminhash")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    prints = stored(fingerprint(docs), "prints")
    same = ["print_a", "print_b", "n_shingles"]
    source = F.struct("doc_id", "text_a", "text_b")
    one = prints.where("n_shingles > 0").groupBy(*same).agg(
        F.min("doc_id").alias("least"), F.min(source).alias("source"), F.min_by("bands", source).alias("bands")
    )
    classes = stored(one.withColumn("rep", F.monotonically_increasing_id()), "classes")

    buckets = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key"))
    leaders = buckets.groupBy("band", "key").agg(F.min(F.struct("rep", "n_shingles")).alias("_lead"), F.count(F.lit(1)).alias("n"))
    leaders = leaders.where("n > 1").select("band", "key", F.col("_lead.rep").alias("leader"), F.col("_lead.n_shingles").alias("size"), "n")
    leaders = stored(leaders, "leaders")  # a table of its own, so that the planner can split a hot bucket
    shared = stored(buckets.join(leaders, ["band", "key"]), "buckets")
    stars = shared.where((F.col("rep") != F.col("leader")) & _fits("n_shingles", "size"))
    met = stars.groupBy("leader", "rep").agg(F.count(F.lit(1)).alias("bands"))
    nearest = met.groupBy("rep").agg(F.max_by("leader", F.struct("bands", -F.col("leader"))).alias("x"))
    tried = stored(nearest.select("x", F.col("rep").alias("y")), "stars")

    names = ["doc_id", "text_a", "text_b"]
    origin = classes.select("rep", *[F.col(f"source.{n}").alias(f"_{n}") for n in names])

    def texts(reps: DataFrame) -> DataFrame:
        """(rep, text) of some classes; repeated rows with the class's id and text count once."""
        wanted = origin.join(reps.distinct(), "rep")
        named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_name(docs["text"]), docs["text"].alias("text"))
        matches = [named[n].eqNullSafe(wanted[f"_{n}"]) for n in names]
        return named.join(wanted, matches).select("rep", "text").dropDuplicates(["rep"])

    reps = tried.select(F.col("x").alias("rep")).unionByName(tried.select(F.col("y").alias("rep")))
    links = stored(_confirmed(tried, stored(texts(reps), "star-texts")), "links")
    first = components(links, "x", "y")

    # What is still apart although it shares a bucket, but for pairs that were just compared.
    owner = first.withColumnsRenamed({"node": "rep"})
    placed = shared.join(owner, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = stored(placed, "placed")
    crowded = placed.groupBy("band", "key").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.min("rep").alias("x"), F.max("rep").alias("y"),
        F.min("n_shingles").alias("_small"), F.max("n_shingles").alias("_large"), F.sum("n_shingles").alias("_all"), F.count(F.lit(1)).alias("n"),
    )
    crowded = crowded.where((F.col("_low") != F.col("_high")) & ((F.col("n") > 2) | _fits("_small", "_large")))
    two = tried.withColumns({"x": F.least("x", "y"), "y": F.greatest("x", "y")}).withColumn("_tried", F.lit(True))
    crowded = crowded.join(two, ["x", "y"], "left").where("n > 2 or _tried is null")
    blocks_of = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("_all") / TILE_SHINGLES)).cast("int")
    crowded = stored(crowded.select("band", "key", blocks_of.alias("blocks")), "crowded")
    rest = stored(placed.select("band", "key", "rep", "component").join(crowded, ["band", "key"]), "rest")
    sets = stored(_sets(texts(rest.select("rep")), ["rep"]), "sets")
    more = stored(_tiled(rest.join(sets, "rep")), "more")

    found = components(links.unionByName(more), "x", "y").withColumnsRenamed({"node": "rep"})
    labels = stored(classes.select(*same, "rep", "least").join(found, "rep", "left").withColumn("label", F.coalesce("component", "rep")), "labels")
    least = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    told = labels.select(*same, "label").join(least, "label")
    return prints.drop("bands").join(told, same, "left").drop("print_a", "print_b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    rows = _classified(docs)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept)


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per component: one with the smallest id. Rows without words or without an id belong to no
    component and stay; equal ids with unrelated texts are components of their own."""
    names, key = docs.columns, ["_doc", "text_a", "text_b"]
    grouped = _classified(docs).where("n_shingles > 0 and doc_id is not null")
    winners = grouped.groupBy("label").agg(F.min(F.struct(F.col("doc_id").alias("_doc"), "text_a", "text_b")).alias("_first")).select("_first.*")
    has_words = F.rlike(F.coalesce(docs["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) & docs["doc_id"].isNotNull()
    rows = docs.select(
        F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].cast("long").alias("_doc"), *_text_name(docs["text"]), has_words.alias("_in")
    )
    linked = rows.where("_in").join(winners, key)
    one = Window.partitionBy(*key).orderBy(F.xxhash64("row"))
    linked = linked.withColumn("_at", F.row_number().over(one)).where("_at = 1")
    return linked.select("row").unionByName(rows.where("not _in").select("row")).select("row.*")
