"""Plain-Python forms of the contracts."""

import hashlib
import re
from collections import Counter, defaultdict

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    found = words((text or "").translate(ASCII_LOWER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4)) or frozenset([tuple(found)])


def components(texts):
    """Smallest id reachable over links of at least 75 percent."""
    sets = {i: shingles(t) for i, t in texts.items()}
    at = defaultdict(list)
    for i, found in sets.items():
        for s in found:
            at[s].append(i)
    shared = Counter((a, b) for ids in at.values() for n, b in enumerate(ids) for a in ids[:n])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def repeats(texts, length=200):
    """(bytes, removed, runs, hash of the rest) per text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[p : p + length] for t in raw for p in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def private(text):
    counts, spans = [], []
    for kind, pattern in PII.items():
        n = 0
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]()
            if good:
                n += 1
                spans.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        for i in range(len(found) - len(parts) + 1):
            if found[i : i + len(parts)] == parts:
                at.append(i)
                labels.add(label)
    return len(found), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def quality(text):
    text = text or ""
    found = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = set()
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(found) < 50 or 100 * len(covered) > 50 * len(found)
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered), failed


def leaks(texts, items):
    def of(text):
        found = words((text or "").lower())
        return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} or ({tuple(found)} if found else set())

    wanted = {i: of(t) for i, t in items.items()}
    out = set()
    for d, text in texts.items():
        have = of(text)
        out |= {(d, i) for i, s in wanted.items() if s and 100 * len(s & have) >= 75 * len(s)}
    return out


def targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """Target per source: caps taken out one after the other."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, done, left = set(names), {}, budget * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return done | {s: level * weight[s] for s in open_}
        for s in full:
            done[s] = most * sizes[s]
            left -= done[s]
        open_ -= full
    return done
