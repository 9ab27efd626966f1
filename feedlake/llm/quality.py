"""Quality rules: distribution divergence from language references.

Every document becomes two histograms: shares of character classes, and shares of common words. Each is
compared with the mean histogram of the document's language by the Jensen-Shannon distance (base 2, so
0 to 1). A document that is too far from its reference is rejected. Histograms of too short texts say
nothing, so each comparison is guarded by a minimum length.

References are learned for every value of ``lang``: the bundled languages from all their documents, others
from at least ``MIN_DOCUMENTS``. A language outside the bundled ones that is written in two scripts (ASCII
letters and others) has one reference for each script with a tenth of its documents. Where a document's
language has no reference, is null, or says nothing (``NO_LANGUAGE``), both distances are 0 and the base
rules alone decide: no document is compared with a foreign language.

Defined results: null and empty texts have zero counts and fail the base rule (fewer than 50 words; words
stand between blanks, so texts in scripts without blanks mostly fail it too); repeated rows are judged each for itself; further columns are carried or ignored, none clashes because
the added columns replace columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.textblocks import U64, Block, distinct_per_row, map_blocks, mix, per_row

# The most frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are as with be by at from this or an have not he",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er sie",
    "fr": "de la le et les des en un une du que est pour qui dans a par plus pas au sur ne se il ce",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "wide", "control")
MIN_WORDS = 50
MIN_CHARS = 200
MIN_DOCUMENTS = 30
MIN_SCRIPT_SHARE = 0.1
NO_LANGUAGE = ("", "und", "mul", "mis", "zxx", "unknown")
MAX_CLASS_DISTANCE = 0.23
MAX_WORD_DISTANCE = 0.45
SCALE = 1_000_000

_VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("punctuation"), np.int64)
    table[:32], table[127] = CLASSES.index("control"), CLASSES.index("control")
    table[[9, 10, 11, 12, 13, 32]] = CLASSES.index("space")
    table[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    table[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    table[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    table[[ord(c) for c in "#*$%&|<>"]] = CLASSES.index("symbol")
    table[192:] = CLASSES.index("wide")
    table[128:192] = len(CLASSES)  # continuation bytes belong to the character before
    return table


_CLASS_OF = _class_table()


def _word_hashes(words: list[str]) -> np.ndarray:
    raw = [np.frombuffer(w.encode(), np.uint8) for w in words]
    bounds = np.cumsum([0, *map(len, raw)])
    prefix = Block(np.concatenate(raw), bounds).prefix_hashes()
    return Block.span_hashes(prefix, bounds[:-1], bounds[1:])


_HASHES = _word_hashes(_VOCABULARY)
_ORDER = np.argsort(_HASHES)


def measure(block: Block) -> dict[str, np.ndarray]:
    """Counts and both histograms (counts per bin, one row per text) of a block."""
    n, data = len(block), block.data
    starts, ends = block.words()
    owner = block.owner(starts)
    lead = (data & 0xC0) != 0x80
    leads = np.concatenate([[0], np.cumsum(lead)])
    n_words = per_row(owner, n)
    word_chars = per_row(owner, n, leads[ends] - leads[starts])
    classes = _CLASS_OF[data]
    texts = np.repeat(np.arange(n), np.diff(block.bounds))
    width = len(CLASSES) + 1
    class_counts = np.bincount(texts * width + classes, minlength=n * width).reshape(n, width)[:, :-1]

    prefix = block.prefix_hashes()
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([block.bounds[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_owner = block.owner(line_starts)
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), block.bounds[line_owner + 1])
    line_ends = line_ends - (data[np.maximum(line_ends - 1, 0)] == 10) * (line_ends > line_starts)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_owner, lines = line_owner[worded], Block.span_hashes(prefix, line_starts[worded], line_ends[worded])
    n_dup_lines = per_row(line_owner, n) - distinct_per_row(line_owner, lines, n)

    hashes = Block.span_hashes(prefix, starts, ends)
    n_repeat = np.zeros(n, np.int64)
    if len(hashes) >= 3:
        same = owner[:-2] == owner[2:]
        keys = mix(mix(mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:]) + owner[:-2].astype(U64) * U64(0x9E3779B97F4A7C15)
        at = np.flatnonzero(same)
        _, which, times = np.unique(mix(keys[at]), return_inverse=True, return_counts=True)
        found = at[times[which] > 1]
        covered = np.zeros(len(hashes), bool)
        for step in range(3):
            covered[found + step] = True
        n_repeat = per_row(owner[covered], n)

    low = block.lowered()
    keys = Block.span_hashes(low.prefix_hashes(), starts, ends)
    spot = np.minimum(np.searchsorted(_HASHES[_ORDER], keys), len(_ORDER) - 1)
    hit = _HASHES[_ORDER][spot] == keys
    bins = len(_VOCABULARY)
    word_counts = np.bincount(owner[hit] * bins + _ORDER[spot[hit]], minlength=n * bins).reshape(n, bins)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": class_counts[:, CLASSES.index("symbol")].astype(np.int64),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "_classes": class_counts,
        "_common": np.column_stack([word_counts, n_words - word_counts.sum(axis=1)]),
    }


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence, base 2) of each row of ``p`` to ``q``."""
    m = (p + q) / 2

    def half(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=-1)

    return np.sqrt(np.clip((half(p) + half(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def other_script(class_counts: np.ndarray) -> np.ndarray:
    """Whether most letters of a text are not ASCII."""
    ascii_letters = class_counts[:, CLASSES.index("lower")] + class_counts[:, CLASSES.index("upper")]
    return class_counts[:, CLASSES.index("wide")] > ascii_letters


def learn_references(docs: DataFrame) -> dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]]:
    """Mean histograms by language and script over all documents that pass the length guards.

    Shares are summed as integers, so that the result does not depend on the order of the sums. What
    comes to the driver is at most two small rows per language with enough documents.
    """
    bins = len(CLASSES) + len(_VOCABULARY) + 1

    def gather(rows, block):
        found = measure(block)
        langs = rows.column(0).to_pylist()
        wide = other_script(found["_classes"])
        fit = (found["n_words"] >= MIN_WORDS) & (found["_classes"].sum(axis=1) >= MIN_CHARS)
        scaled = np.hstack([shares(found["_classes"]), shares(found["_common"])])
        scaled = np.rint(scaled * SCALE).astype(np.int64)
        groups: dict[tuple[str, bool], list[int]] = {}
        for row in np.flatnonzero(fit):
            lang = langs[row]
            groups.setdefault((lang, lang not in COMMON_WORDS and bool(wide[row])), []).append(row)
        return {
            "lang": pa.array([lang for lang, _ in groups], pa.string()),
            "other": pa.array([other for _, other in groups], pa.bool_()),
            "n": pa.array([len(chosen) for chosen in groups.values()], pa.int64()),
            "sums": pa.array([scaled[chosen].sum(axis=0).tolist() for chosen in groups.values()], pa.list_(pa.int64())),
        }

    known = docs.where(~F.col("lang").isin(*NO_LANGUAGE)).select("lang", "text")
    partial = map_blocks(known, "lang string, other boolean, n long, sums array<long>", gather)
    totals = partial.groupBy("lang", "other").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(bins)], F.sum("n").alias("n"))
    bundled = F.col("lang").isin(*COMMON_WORDS)
    rows = totals.where(bundled | (F.col("n") >= MIN_DOCUMENTS)).collect()
    of_lang: dict[str, int] = {}
    for row in rows:
        of_lang[row["lang"]] = of_lang.get(row["lang"], 0) + row["n"]
    references = {}
    for row in rows:
        if row["n"] >= MIN_SCRIPT_SHARE * of_lang[row["lang"]]:
            mean = np.array([row[f"s{i}"] for i in range(bins)], float) / row["n"] / SCALE
            parts = mean[: len(CLASSES)], mean[len(CLASSES) :]
            references[row["lang"], row["other"]] = tuple(p / max(p.sum(), 1e-12) for p in parts)
    return references


def judge(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the base counts, both distances and the verdict ``kept``.

    ``kept`` is false where the base rules fail (fewer than 50 words, or more than half of the words in
    repeated three-word windows), or where a guarded distance to the document's own language exceeds its
    limit; without a reference of that language the base rules alone decide.
    """
    references = learn_references(docs)
    names = [c for c in docs.columns if c not in VERDICT]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    schema = f"{fields}, {', '.join(f'{k} {v}' for k, v in VERDICT.items())}"

    def score(rows, block):
        found = measure(block)
        classes, common = found.pop("_classes"), found.pop("_common")
        n = len(block)
        away = np.zeros((2, n))
        langs = rows.column(rows.schema.get_field_index("lang")).to_pylist()
        own: dict[tuple[str, bool], list[int]] = {}
        for row, (lang, other) in enumerate(zip(langs, other_script(classes).tolist(), strict=True)):
            key = (lang, other) if (lang, other) in references else (lang, not other)
            if key in references:
                own.setdefault(key, []).append(row)
        for key, chosen in own.items():
            for part, counts in enumerate((classes, common)):
                away[part, chosen] = js_distance(shares(counts[chosen]), references[key][part])
        long_enough = classes.sum(axis=1) >= MIN_CHARS, found["n_words"] >= MIN_WORDS
        away = np.where(np.array(long_enough), away, 0.0)
        failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
        kept = ~failed & (away[0] <= MAX_CLASS_DISTANCE) & (away[1] <= MAX_WORD_DISTANCE)
        out = {name: rows.column(rows.schema.get_field_index(name)) for name in names}
        return out | found | {
            "class_distance": away[0],
            "word_distance": away[1],
            "base_failed": failed,
            "kept": kept,
        }

    return map_blocks(docs, schema, score)


VERDICT = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "class_distance": "double",
    "word_distance": "double",
    "base_failed": "boolean",
    "kept": "boolean",
}
