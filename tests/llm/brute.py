"""Plain Python versions of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter, defaultdict

import xxhash

LOWER = {i: i + 32 for i in range(65, 91)}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def contamination(docs, items, window=10):
    """doc_id -> (words, hit words, sorted items as strings)."""
    out = []
    for doc_id, text in docs:
        words, hit, found = item_words(text), set(), set()
        for item, item_text in items:
            w = item_words(item_text)
            n = min(window, len(w))
            for a in range(len(w) - n + 1) if w else ():
                for i in range(len(words) - n + 1):
                    if words[i : i + n] == w[a : a + n]:
                        hit |= set(range(i, i + n))
                        found.add(item)
        names = sorted(map(str, found))
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text, n):
    w = plain_words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(docs, n, percent):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = [(d, shingles(t, n)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(d, len(s), root(d)) for d, s in sets]


def repeats(docs, window=50):
    """(doc_id, words, removed, hash of what is kept)."""
    first = {}
    for d, t in docs:
        w = plain_words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t in docs:
        w = plain_words(t)
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def measures(text):
    """words, characters in words, symbols, repeated lines, repeated words."""
    t = text or ""
    w = plain_words(t)
    lines = [x for x in t.split("\n") if plain_words(x)]
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Source -> target of sizes by source; None sorts last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            out |= share
            break
        out |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return out


def spark_hash(*values):
    """xxhash64 of long columns as the engine's built-in computes it; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def permuted(x, n, *keys, rounds=24):
    for r in range(1, rounds + 1):
        other = (spark_hash_int(r, n, *keys) % n - x) % n
        if spark_hash_int_after(max(x, other), r, n, *keys) % 2 == 1:
            x = other
    return x


def spark_hash_int(r, *longs):
    """The round is an int column, the rest are longs."""
    h = xxhash_int(r, 42)
    for v in longs:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def spark_hash_int_after(first, r, *longs):
    h = xxhash_int(r, xxhash.xxh64_intdigest(struct.pack("<q", first), 42))
    for v in longs:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def xxhash_int(v, seed):
    return xxhash.xxh64_intdigest(struct.pack("<I", v & 0xFFFFFFFF), seed)


def mixture(rows, block, shard_slots, seed=11, buckets=1024, weights=(5, 2, 1), cap=3):
    """Counter of (doc_id, source, size) -> words taken, and (shard, slot) -> (source, block) of the mix of rows (doc_id, source, size)."""
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = targets(sizes, weights, cap)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    blocks = {s: -(-sizes[s] // block) for s in order}
    slots = {}
    for s in order:
        epochs = int(want[s] / sizes[s] + 1e-12) if sizes[s] else 0
        rest = (want[s] - epochs * sizes[s]) * blocks[s] / sizes[s] if sizes[s] else 0
        slots[s] = epochs * blocks[s] + int(rest + 0.5)
    total, first, at = sum(slots.values()), {}, 0
    for s in order:
        first[s] = at
        at += slots[s]
    drawn = defaultdict(Counter)
    for place in range(total):
        shard, slot = divmod(place, shard_slots)
        x = spark_hash(shard, slot, seed) % total
        drawn[shard][next(s for s in order if first[s] <= x < first[s] + slots[s])] += 1
    used, places, beyond = Counter(), {}, {s: [] for s in order}
    for shard in sorted(drawn):
        at = 0
        for s in order:
            for _ in range(drawn[shard][s]):
                if used[s] < slots[s]:
                    places[shard, at] = (s, used[s])
                else:
                    beyond[s].append((shard, at))
                used[s] += 1
                at += 1
    spare = iter([p for s in order for p in beyond[s]])
    for s in order:
        for q in range(min(used[s], slots[s]), slots[s]):
            places[next(spare)] = (s, q)
    out, times = {}, Counter()
    for (shard, at), (s, q) in places.items():
        epoch, i = divmod(q, blocks[s])
        b = permuted(i, blocks[s], seed, order.index(s), epoch)
        times[s, b] += 1
        out[shard, permuted(at, min(shard_slots, total - shard * shard_slots), seed, shard)] = (order.index(s), b)
    taken = Counter()
    for s in order:
        start = 0
        for d, _, n in sorted((r for r in rows if r[1] == s and r[2]), key=lambda r: (spark_hash(r[0], r[2]) % buckets, r[0] is not None, r[0] or 0, r[2])):
            taken[d, s, n] += sum(times[s, i // block] for i in range(start, start + n))
            start += n
    return taken, out
