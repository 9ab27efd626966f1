"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A text is a row of words (letters, digits and non-ASCII characters, A-Z lower-cased). Every word enters as
the vector of its dictionary entry (words of the training sample) beside the mean vector of its hashed
character n-grams, so unseen forms of a seen stem count. The network reads overlapping windows of
``WINDOW`` words, forwards and backwards, pools the states with attention and gives one logit; a text
scores as its most toxic window, and every window of every text is scored.

Training runs in numpy on a bounded sample: at most ``SAMPLE`` labelled rows per class (smallest hashes of
their ids first), texts of at most ``SAMPLE_BYTES`` bytes. Labels mark texts, not windows: after a first
round on all windows only the most toxic window of a positive text stays positive, and the negative
windows that look most toxic are shown again. The output is shifted so that 0.5 is the best cut on a part
of the sample that the weights were not trained on.

Defined results: texts without words (null and empty ones too) score 0; without labelled rows of both
classes every score is 0; labels that are null or have no document teach nothing; repeated rows are
scored each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.textblocks import U64, Block, blocks, mix

WINDOW, STRIDE = 32, 16
SAMPLE, SAMPLE_BYTES = {0: 6000, 1: 2500}, 32768
VOCABULARY, LEAST_TEXTS = 20000, 12
#: Every so many-th sample text is kept back to place the cut.
HELD_BACK = 4
GRAM_BUCKETS = 1 << 14
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 12, 8, 8
ROUNDS, BATCH, RATE, DECAY = (1, 4), 512, 0.01, 0.002
#: Steps of a round on a sample too small for full batches.
STEPS = 48
#: Windows of negative sample texts used per round, and how many of them are the most toxic looking ones.
NEGATIVE_WINDOWS, HARD_WINDOWS = 20000, 5000
#: Share of word vectors blanked in training, so that the characters have to carry.
BLANKED = 0.3
SCORE_BLOCK = 4 << 20

GAPS = np.ones(256, bool)
GAPS[48:58] = GAPS[65:91] = GAPS[97:123] = GAPS[128:] = False


class Texts:
    """The words of a block: unique words with their n-grams, and the windows of every text."""

    def __init__(self, block: Block):
        low = block.lowered()
        starts, ends = low.words(GAPS)
        prefix = low.prefix_hashes()
        self.n = len(block)
        keys = Block.span_hashes(prefix, starts, ends)
        self.unique, first, self.which = np.unique(keys, return_index=True, return_inverse=True)
        head, tail = starts[first], ends[first]
        length = tail - head
        grams, owners = [], []
        # Byte n-grams; the ones at a word's head are told apart. Short words are one gram.
        for width in (3, 4, 5):
            count = np.maximum(length - width + 1, (length < width) & (width == 3))
            owner = np.repeat(np.arange(len(head)), count)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            a = head[owner] + step
            gram = Block.span_hashes(prefix, a, np.minimum(a + width, tail[owner]))
            grams.append(mix(gram + U64(width) + (step == 0).astype(U64) * U64(977)) & U64(GRAM_BUCKETS - 1))
            owners.append(owner)
        self.grams = np.concatenate(grams).astype(np.int64)
        owners = np.concatenate(owners)
        order = np.argsort(owners, kind="stable")  # the n-grams of a word together
        self.grams = self.grams[order]
        self.counts = np.bincount(owners, minlength=len(self.unique))
        self.heads = np.cumsum(self.counts) - self.counts
        words = np.bincount(block.owner(starts), minlength=self.n)
        begin = np.cumsum(words) - words
        windows = np.where(words > 0, 1 + np.maximum(0, -(-(words - WINDOW) // STRIDE)), 0)
        self.text = np.repeat(np.arange(self.n), windows)
        nth = np.arange(len(self.text)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start = begin[self.text] + nth * STRIDE
        self.stop = np.minimum(self.start + WINDOW, (begin + words)[self.text])

    @classmethod
    def merged(cls, parts: list[Texts]) -> Texts:
        """The texts of several blocks as one; each unique word keeps the n-grams of its first block."""
        whole = cls.__new__(cls)
        whole.n = sum(p.n for p in parts)
        whole.unique, first, which = np.unique(np.concatenate([p.unique for p in parts]), return_index=True, return_inverse=True)
        offsets = {k: np.cumsum([0, *(len(getattr(p, k)) for p in parts)]) for k in ("unique", "grams", "which")}
        rows = np.cumsum([0, *(p.n for p in parts)])
        whole.which = np.concatenate([which[o + p.which] for o, p in zip(offsets["unique"], parts, strict=False)])
        heads = np.concatenate([p.heads + o for o, p in zip(offsets["grams"], parts, strict=False)])[first]
        whole.counts = np.concatenate([p.counts for p in parts])[first]
        whole.heads = np.cumsum(whole.counts) - whole.counts
        at = np.repeat(heads - whole.heads, whole.counts) + np.arange(int(whole.counts.sum()))
        whole.grams = np.concatenate([p.grams for p in parts])[at]
        whole.text = np.concatenate([p.text + o for o, p in zip(rows, parts, strict=False)])
        for name in ("start", "stop"):
            setattr(whole, name, np.concatenate([getattr(p, name) + o for o, p in zip(offsets["which"], parts, strict=False)]))
        return whole

    def window(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unique-word numbers (window by place) and the mask of places that have a word."""
        at = self.start[chosen, None] + np.arange(WINDOW)
        mask = at < self.stop[chosen, None]
        return self.which[np.where(mask, at, self.start[chosen, None])], mask


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters by name; ``vocabulary`` holds the sorted hashes of the dictionary words (entry 0: unknown)."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        random = np.random.default_rng(seed)
        self.vocabulary = np.sort(vocabulary)
        inputs, h = WORD_DIM + CHAR_DIM, HIDDEN

        def weights(*shape):
            return (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "word": (random.standard_normal((len(vocabulary) + 1, WORD_DIM)) * 0.1).astype(np.float32),
            "char": (random.standard_normal((GRAM_BUCKETS, CHAR_DIM)) * 0.3).astype(np.float32),
            "in": weights(inputs, 6 * h),
            "bias": np.zeros(6 * h, np.float32),
            "up": weights(h, 3 * h),
            "down": weights(h, 3 * h),
            "attend": weights(2 * h, ATTENTION),
            "point": weights(ATTENTION, 1)[:, 0],
            "out": weights(2 * h, 1)[:, 0],
            "shift": np.zeros(1, np.float32),
        }

    def entries(self, unique: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(unique), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, unique), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == unique, at + 1, 0)

    def inputs(self, texts: Texts, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of (the used ones of) the unique words, their dictionary entries, n-grams and n-gram owners."""
        grams, counts, heads = texts.grams, texts.counts, texts.heads
        entry = self.entries(texts.unique if used is None else texts.unique[used])
        if used is not None:
            counts = counts[used]
            begin = np.cumsum(counts) - counts
            at = np.repeat(heads[used] - begin, counts) + np.arange(int(counts.sum()))
            grams, heads = grams[at], begin
        if not len(heads):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32), entry, grams, counts
        sums = np.empty((len(heads), CHAR_DIM), np.float32)
        for a in range(0, len(heads), 1 << 15):  # words in portions, as the gathered n-grams take the most memory
            part = heads[a : a + (1 << 15)]
            stop = heads[a + len(part)] if a + len(part) < len(heads) else len(grams)
            sums[a : a + len(part)] = np.add.reduceat(self.p["char"][grams[part[0] : stop]], part - part[0], axis=0)
        vectors = np.hstack([self.p["word"][entry], sums / counts[:, None].astype(np.float32)])
        return vectors.astype(np.float32), entry, grams, counts

    def _pass(self, gates: np.ndarray, mask: np.ndarray, weights: np.ndarray, order) -> tuple[np.ndarray, list]:
        """One direction over ``gates`` (place, window, 3h); keeps what the way back needs."""
        h = HIDDEN
        state = np.zeros((gates.shape[1], h), np.float32)
        states, kept = np.zeros((WINDOW, gates.shape[1], h), np.float32), [None] * WINDOW
        for t in order:
            recur = state @ weights
            zr = _sigmoid(gates[t, :, : 2 * h] + recur[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[t, :, 2 * h :] + r * recur[:, 2 * h :])
            on = mask[:, t, None]
            kept[t] = (state, z, r, new, recur[:, 2 * h :], on)
            state = np.where(on, new + z * (state - new), state)
            states[t] = state
        return states, kept

    def forward(self, projected: np.ndarray, words: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        gates = projected[words.T]
        h = HIDDEN
        ahead = self._pass(gates[:, :, : 3 * h], mask, self.p["up"], range(WINDOW))
        back = self._pass(gates[:, :, 3 * h :], mask, self.p["down"], range(WINDOW - 1, -1, -1))
        states = np.concatenate([ahead[0], back[0]], axis=2)
        seen = np.tanh(states @ self.p["attend"])
        energy = np.where(mask.T, seen @ self.p["point"], -1e9)
        share = np.exp(energy - energy.max(axis=0))
        share = share / share.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", share, states)
        return pooled @ self.p["out"] + self.p["shift"][0], (gates, ahead[1], back[1], states, seen, share, pooled)

    def gradients(self, slope: np.ndarray, kept: tuple, mask: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the recurrent and pooling weights, and of the gate inputs (place, window, 6h)."""
        gates, ahead, back, states, seen, share, pooled = kept
        h, g = HIDDEN, {}
        g["out"], g["shift"] = pooled.T @ slope, np.array([slope.sum()], np.float32)
        to_pooled = slope[:, None] * self.p["out"]
        to_states = share[:, :, None] * to_pooled
        to_share = np.einsum("bh,tbh->tb", to_pooled, states)
        to_energy = share * (to_share - (share * to_share).sum(axis=0))
        g["point"] = np.einsum("tb,tba->a", to_energy, seen)
        to_seen = to_energy[:, :, None] * self.p["point"] * (1 - seen**2)
        g["attend"] = np.einsum("tbh,tba->ha", states, to_seen)
        to_states = to_states + to_seen @ self.p["attend"].T
        to_gates = np.zeros_like(gates)
        for name, steps, order, at in (("up", ahead, range(WINDOW - 1, -1, -1), 0), ("down", back, range(WINDOW), 1)):
            weights, total = self.p[name], np.zeros_like(self.p[name])
            flow = np.zeros((gates.shape[1], h), np.float32)
            for t in order:
                state, z, r, new, recur, on = steps[t]
                flow = flow + to_states[t, :, at * h : (at + 1) * h]
                live = np.where(on, flow, 0)
                to_new = live * (1 - z) * (1 - new**2)
                to_z = live * (state - new) * z * (1 - z)
                to_r = to_new * recur * r * (1 - r)
                inner = np.hstack([to_z, to_r, to_new * r])
                to_gates[t, :, at * 3 * h : (at + 1) * 3 * h] = np.hstack([to_z, to_r, to_new])
                total += state.T @ inner
                flow = np.where(on, live * z + inner @ weights.T, flow)
            g[name] = total
        return g, to_gates

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.p["in"] + self.p["bias"]

    def logits(self, texts: Texts, batch: int = 2048) -> np.ndarray:
        """Logit of every window."""
        if not len(texts.start):
            return np.zeros(0, np.float32)
        projected = self.project(self.inputs(texts)[0]).astype(np.float32)
        out = [
            self.forward(projected, *texts.window(np.arange(at, min(at + batch, len(texts.start)))))[0]
            for at in range(0, len(texts.start), batch)
        ]
        return np.concatenate(out)

    def text_logits(self, texts: Texts) -> np.ndarray:
        """Largest logit of each text's windows; minus infinity without words."""
        best = np.full(texts.n, -np.inf)
        np.maximum.at(best, texts.text, self.logits(texts))
        return best


def _texts(sample: list[tuple[str, int]]) -> Texts:
    column = pa.array([text or "" for text, _ in sample], pa.large_string())
    return Texts.merged([Texts(block) for _, _, block in blocks(column)])


def fit(sample: list[tuple[str, int]], seed: int = 7) -> Network | None:
    """Train on (text, label) rows; None unless both labels occur."""
    labels = np.array([int(label) for _, label in sample])
    if not len(labels) or labels.min() == labels.max():
        return None
    random = np.random.default_rng(seed)
    order = random.permutation(len(sample))
    back = order[::HELD_BACK] if labels[order[::HELD_BACK]].any() and len(sample) >= 40 else order
    front = np.setdiff1d(order, back) if back is not order else order
    texts, truth_of = _texts([sample[i] for i in front]), labels[front]
    owner = texts.text.repeat(WINDOW)
    words = texts.window(np.arange(len(texts.start)))[0].ravel()
    pairs = np.unique(owner.astype(np.int64) * len(texts.unique) + words)
    times = np.bincount(pairs % len(texts.unique), minlength=len(texts.unique))
    common = np.argsort(-times, kind="stable")[:VOCABULARY]
    net = Network(texts.unique[common[times[common] >= LEAST_TEXTS]], seed)
    truth = truth_of[texts.text].astype(np.float32)
    positive, negative = np.flatnonzero(truth == 1), np.flatnonzero(truth == 0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    tick = 0
    for stage, rounds in enumerate(ROUNDS):
        for _ in range(rounds):
            chosen = random.permutation(negative)[:NEGATIVE_WINDOWS]
            shown = positive
            if stage:
                logit = net.logits(texts)
                best = np.full(texts.n, -np.inf)
                np.maximum.at(best, texts.text, logit)
                shown = np.flatnonzero((truth == 1) & (logit == best[texts.text]))
                hard = negative[np.argsort(-logit[negative], kind="stable")[:HARD_WINDOWS]]
                chosen = np.concatenate([chosen[: NEGATIVE_WINDOWS - HARD_WINDOWS], hard])
            elif len(shown) > NEGATIVE_WINDOWS:
                shown = random.permutation(shown)[:NEGATIVE_WINDOWS]
            chosen = random.permutation(np.concatenate([chosen, shown, shown[: len(shown) * bool(stage)]]))
            batch = min(BATCH, max(32, len(chosen) // STEPS))
            for at in range(0, len(chosen), batch):
                tick += 1
                _step(net, texts, chosen[at : at + batch], truth, moments, tick, random)
    cut = _cut(net.text_logits(_texts([sample[i] for i in back])), labels[back])
    net.p["shift"] = net.p["shift"] - np.float32(cut)
    return net


def _summed(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of ``values`` per row number."""
    total = np.zeros((size, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        heads = np.flatnonzero(np.diff(rows[order], prepend=-1))
        total[rows[order][heads]] = np.add.reduceat(values[order], heads, axis=0)
    return total


def _step(net: Network, texts: Texts, chosen: np.ndarray, truth: np.ndarray, moments: dict, tick: int, random) -> None:
    words, mask = texts.window(chosen)
    used, local = np.unique(words, return_inverse=True)
    local = local.reshape(words.shape)
    vectors, entry, grams, counts = net.inputs(texts, used)
    blank = random.random(len(used)) < BLANKED
    vectors[blank, :WORD_DIM] = 0
    logit, kept = net.forward(net.project(vectors).astype(np.float32), local, mask)
    slope = ((_sigmoid(logit) - truth[chosen]) / len(chosen)).astype(np.float32)
    g, to_gates = net.gradients(slope, kept, mask)
    to_used = _summed(local.T.ravel(), to_gates.reshape(-1, to_gates.shape[2]), len(used))
    g["in"], g["bias"] = vectors.T @ to_used, to_used.sum(axis=0)
    to_vectors = to_used @ net.p["in"].T
    g["word"] = _summed(entry[~blank], to_vectors[~blank, :WORD_DIM], len(net.p["word"]))
    spread = (to_vectors[:, WORD_DIM:] / counts[:, None]).repeat(counts, axis=0)
    g["char"] = _summed(grams, spread.astype(np.float32), GRAM_BUCKETS)
    for name, value in net.p.items():
        first, second = moments[name]
        first += 0.1 * (g[name] - first)
        second += 0.001 * (g[name] ** 2 - second)
        scale = RATE * np.sqrt(1 - 0.999**tick) / (1 - 0.9**tick)
        value -= (scale * first / (np.sqrt(second) + 1e-8)).astype(np.float32)
        if name in ("word", "char", "in"):
            value *= 1 - DECAY


def _cut(best: np.ndarray, labels: np.ndarray) -> float:
    """The logit that parts the sample best, a false alarm weighing ``ALARM`` misses; halfway in its gap."""
    order = np.argsort(-best, kind="stable")
    hits = np.cumsum(labels[order]) / max(labels.sum(), 1)
    alarms = np.cumsum(1 - labels[order]) / max((1 - labels).sum(), 1)
    at = int(np.argmax(hits - ALARM * alarms))
    values = best[order]
    above = values[at]
    below = values[at + 1] if at + 1 < len(values) and np.isfinite(values[at + 1]) else above - 1
    return float((above + below) / 2)


ALARM = 3.0


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Fit on the bounded sample of ``labels`` (doc_id, toxic) joined with ``docs`` (doc_id, text).

    The sample is a table of at most the rows of ``SAMPLE`` and the fit is one task on it, which runs again like
    any other if its executor is lost. Only the network comes to the driver.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text")
    usable = known.join(rows.select("doc_id"), "doc_id", "left_semi").withColumn("_hash", F.xxhash64("doc_id"))
    chosen = [usable.where(F.col("toxic") == label).orderBy("_hash", "doc_id").limit(SAMPLE[label]) for label in (0, 1)]
    wanted = chosen[0].union(chosen[1]).select("doc_id", "toxic")  # at most sum(SAMPLE) rows
    one = rows.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def run(batches):
        sample = [row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True)]
        net = fit([(text, toxic) for _, text, toxic in sorted(sample)]) if sample else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    fitted = one.select("doc_id", "text", "toxic").repartition(1).mapInArrow(run, "net binary").collect()
    return pickle.loads(fitted[0]["net"]) if fitted else None


def score(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with ``score`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in keep)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at, to, block in blocks(batch.column(batch.schema.get_field_index("text")), SCORE_BLOCK):
                found = np.zeros(to - at)
                if model is not None:
                    found = _sigmoid(np.clip(model.text_logits(Texts(block)), -60, 60))
                    found[found < 1e-20] = 0.0
                rows = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(len(keep))), pa.array(found, pa.float64())], names=[*keep, "score"]
                )

    return kept.mapInArrow(run, f"{fields}, score double")
