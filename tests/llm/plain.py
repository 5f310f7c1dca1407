"""Plain versions of what several tests compare with, in strings and dictionaries."""

import math
import re
from collections import Counter

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def shingle_weights(texts):
    """Of each text a dictionary of its runs of five words (or all words) and their weights."""
    cut = [WORD.findall(t.lower()) for t in texts]
    held = Counter(w for words in cut for w in set(words))
    n = len(texts)
    idf = {w: math.log((n + 1) / (k + 1)) / math.log(n + 2) for w, k in held.items()}
    out = []
    for words in cut:
        size = min(5, len(words))
        runs = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if size else {}
        out.append({r: k * (1 + sum(idf[w] for w in r) / size) for r, k in runs.items()})
    return out


def similar(a, b, limit=0.8):
    if not a or not b:
        return False
    total = sum(a.values()) + sum(b.values())
    shared = sum(min(x, b[k]) for k, x in a.items() if k in b)
    return shared >= limit * (total - shared)


def near_groups(texts):
    """The group of each text: equal texts, and components of similar ones."""
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = shingle_weights(texts)
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or similar(sets[i], sets[j]):
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(texts))]


def trigram_cosines(text, model):
    """The cosine of a text with each centroid of a language model, and its number of trigrams."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.lower().encode() + b" ") if letters.strip() else b"  "
    counts = Counter(((int.from_bytes(raw[i : i + 3], "big") * 2654435761) & 0xFFFFFFFF) >> 19 for i in range(len(raw) - 2))
    vector = {k: math.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in vector.values())) or 1.0
    return [sum(x * float(c[k]) for k, x in vector.items()) / norm for c in model.centroids], sum(counts.values())


def accepted(text, model):
    """Whether a language model keeps a text."""
    if not any(c.isalpha() for c in text):
        return False
    cosines, n = trigram_cosines(text, model)
    best = max(range(len(cosines)), key=lambda i: cosines[i])
    sizes, limits = [1, 4, 16, 64, 256, 1024], model.limits[best]
    at = max(k for k in range(len(sizes)) if k == 0 or sizes[k] <= n)
    if at == len(sizes) - 1:
        return cosines[best] >= limits[-1]
    part = math.log(max(n, 1) / sizes[at]) / math.log(sizes[at + 1] / sizes[at])
    return cosines[best] >= limits[at] + part * (limits[at + 1] - limits[at])
