"""Plain versions of the operators for small inputs."""

import math
import zlib


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def smallest_reachable(ids, links):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed = changed or least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def text_groups(texts, k, percent=80):
    """id -> smallest id reachable, for {id: text}."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    links = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return smallest_reachable(sets, links), {i: len(s) for i, s in sets.items()}


def jump(key, shards):
    """The published jump consistent hash."""
    key %= 2**64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def kneser_ney(training, texts):
    """Scores of texts by an interpolated modified Kneser-Ney bigram model, dictionaries only."""
    from collections import Counter, defaultdict

    pairs = Counter()
    unigrams = Counter()
    for text in training:
        before = None
        for token in [*words(text), None]:
            pairs[before, token] += 1
            unigrams[token] += 1
            before = token

    def discounts(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else y for k in (1, 2, 3)]
        return [0.0, *[min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(raw, 1)]]

    top = discounts(pairs.values())
    left = Counter(w for _, w in pairs)
    low = discounts(left.values())
    total, bonus = defaultdict(int), defaultdict(float)
    for (h, _), c in pairs.items():
        total[h] += c
        bonus[h] += top[min(c, 3)]
    mass, types, vocabulary = sum(low[min(c, 3)] for c in left.values()), sum(left.values()), len(unigrams)

    def probability(h, w):
        c = left[w]
        unigram = (c - low[min(c, 3)] + mass / (vocabulary + 1)) / types
        if not total.get(h):
            return unigram
        c = pairs[h, w]
        return (c - top[min(c, 3)] + bonus[h] * unigram) / total[h]

    n = sum(unigrams.values())
    out = []
    for text in texts:
        score = base = 0.0
        before, known, tokens = None, 0, [*words(text), None]
        for token in tokens:
            score += math.log10(probability(before, token))
            base += math.log10((unigrams[token] + 0.1) / (n + 0.1 * (vocabulary + 1)))
            known += unigrams[token] > 0
            before = token
        out.append((len(tokens), known, n, base, score))
    return out, probability, [*unigrams, b"never seen"]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0
