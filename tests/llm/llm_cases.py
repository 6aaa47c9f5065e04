"""Rows that every operator must stand, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

EXTRA = ["key", "node", "maybe", "score", "others", "chunks", "page", "weight"]
SCHEMA = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)


def frame(spark, rows):
    """Documents (id, text) with columns whose names clash with those used within operators."""
    return spark.createDataFrame([(i, t, *["x"] * len(EXTRA)) for i, t in rows], SCHEMA)


SENTENCE = "the quick brown fox jumps over the lazy dog near the old river bank while seven grey herons watch it pass by"
LONG = " ".join(f"word{i * 7919 % 5003} and{i % 97}" for i in range(60_000))
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (6, SENTENCE), (7, SENTENCE), (7, SENTENCE),
    (8, SENTENCE.upper()), (None, SENTENCE), (None, None), (9, LONG), (10, LONG + " tail"), (11, "漢字 🙂 é́ 'tis don't   x\n\n"),
]


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(rows, n, percent):
    """{row number: smallest id of its group} by comparing all pairs that share an n-gram."""
    sets = [shingles(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, j in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return {i: least.get(find(i)) for i in range(len(rows))}


def cut_lines(rows, lines=3, least=2):
    """(text, lines, removed chunks, removed lines) of each row, ids ascending and unique."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out.append((None, 0, 0, 0))
            continue
        split = text.split("\n")
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in split]
        chunks, current = [], []
        for i, line in enumerate(split):
            current.append(line)
            if i == len(split) - 1 or (hashes[i] + 31 * (hashes[i - 1] if i else 0)) % lines == 0:
                chunks.append(current)
                current = []
        kept, gone = [], []
        for c in chunks:
            text_of = "\n".join(c)
            (gone if len(c) >= least and text_of in seen else kept).append(c)
            if len(c) >= least:
                seen.add(text_of)
        out.append(("\n".join("\n".join(c) for c in kept), len(split), len(gone), sum(map(len, gone))))
    return out
