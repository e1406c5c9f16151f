"""Plain restatements of what the operators compute, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < k else zip(*[words[i:] for i in range(k)], strict=False))


def components(docs, k, share=80):
    """{id: smallest id reachable} for [(id, text)]."""
    sets = [(d, shingles(t, k)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= share * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d, _ in docs}


def cut_repeats(docs, k=20):
    """{id: (words, removed places)} for [(id, text)]."""
    first, words = {}, {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), (d, i))
    return {d: (w, {i + j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] != (d, i) for j in range(k)}) for d, w in words.items()}


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def least_capacity(sizes, shards):
    """The smallest capacity of contiguous shards, by trying all."""

    def fits(c):
        n, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low
