"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of two and three code points per language over all training rows (a dense count
row per language inside the tasks, summed by Spark). The smoothed log-probability matrix has a fixed
number of buckets per language and is the only thing broadcast; its size is checked. Scoring gathers the
matrix rows of a batch's n-grams and sums them per text.

Defined results: null texts and texts without a letter get ``und`` with score 0, and so does every text
when nothing was learned. Ties go to the language that comes first in code-point order. Empty training
texts add a document to their language but no n-grams. Repeated rows are scored each for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.textblocks import U64, blocks

BUCKETS = 1 << 15
SMOOTHING = 0.5
#: The matrix is broadcast; more languages than this are refused.
MAX_LANGUAGES = 256
UNKNOWN = "und"


def grams(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of a block, and whether each row has a letter.

    Letters are lower-cased; everything else counts as one blank, so digits and marks say nothing.
    """
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([0, *map(len, texts)])
    points, which = np.unique(joined, return_inverse=True) if len(joined) else (joined, joined)
    letter = np.array([chr(p).isalpha() for p in points], bool)
    letters = letter[which] if len(joined) else np.zeros(0, bool)
    codes = np.where(letters, joined, 32).astype(U64)
    rows = np.repeat(np.arange(len(texts)), np.diff(ends))
    has_letter = np.bincount(rows[letters], minlength=len(texts)) > 0
    found, owner = [], []
    for width in (2, 3):
        n = len(codes) - width + 1
        if n <= 0:
            continue
        key = codes[:n].copy()
        for step in range(1, width):
            key = key * U64(0x100000001B3) + codes[step : step + n]
        key = (key * U64(0x9E3779B97F4A7C15)) >> U64(64 - BUCKETS.bit_length() + 1)
        inside = (rows[:n] == rows[width - 1 :]) & letters[width // 2 : width // 2 + n]
        found.append(key[inside].astype(np.int64))
        owner.append(rows[:n][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has_letter
    return np.concatenate(found), np.concatenate(owner), has_letter


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their log-probabilities (bucket by language), with a last row
    holding the log prior. ``labelled`` has lang (not null) and text; all its rows are counted."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for at, to, block in blocks(batch.column(batch.schema.get_field_index("text"))):
                names, codes = np.unique(np.array(langs[at:to], object).astype(str), return_inverse=True)
                bucket, row, _ = grams(block.data.tobytes(), block.bounds)
                dense = np.bincount(codes[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                for i, name in enumerate(names):
                    part = dense[i * BUCKETS : (i + 1) * BUCKETS]
                    totals[name] = totals[name] + part if name in totals else part
                    sizes[name] = sizes.get(name, 0) + int((codes == i).sum())
        for name, dense in totals.items():
            used = np.flatnonzero(dense)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(used) + 1), pa.string()),
                    pa.array(np.append(used, BUCKETS), pa.int32()),
                    pa.array(np.append(dense[used], sizes[name]), pa.int64()),
                ],
                names=["lang", "bucket", "n"],
            )

    partial = labelled.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    sums = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sizes = sums.where(F.col("bucket") == BUCKETS).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the matrix would not be small any more")
    if not sizes:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    languages = sorted(r["lang"] for r in sizes)
    counts = np.zeros((BUCKETS, len(languages)))
    index = {lang: i for i, lang in enumerate(languages)}
    table = sums.where(F.col("bucket") < BUCKETS).toPandas()  # at most BUCKETS rows per language
    counts[table["bucket"].to_numpy(), table["lang"].map(index).to_numpy(int)] = table["n"].to_numpy()
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * BUCKETS)
    docs = np.array([{r["lang"]: r["n"] for r in sizes}[lang] for lang in languages], float)
    return languages, np.vstack([logs, np.log(docs / docs.sum())]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row, with ``lang_pred`` and ``score`` (the posterior probability)."""
    languages, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    kept = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in keep)

    def run(batches):
        logs = shared.value
        for batch in batches:
            for at, to, block in blocks(batch.column(batch.schema.get_field_index("text"))):
                bucket, row, has_letter = grams(block.data.tobytes(), block.bounds)
                n = len(block)
                names, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if languages:
                    total = np.tile(logs[BUCKETS].astype(float), (n, 1))
                    for i in range(len(languages)):
                        total[:, i] += np.bincount(row, logs[:BUCKETS, i][bucket], minlength=n)
                    best = total.argmax(axis=1)
                    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    names = np.array(languages, object)[best]
                names, score = np.where(has_letter, names, UNKNOWN), np.where(has_letter, score, 0.0)
                rows = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(score)],
                    names=[*keep, "lang_pred", "score"],
                )

    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double")
