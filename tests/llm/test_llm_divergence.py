import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import LONG, SENTENCE

from controlweave.llm import divergence
from controlweave.llm.divergence import PerfectHash, Rule, _flat, hashed, rounds, shard_of, shares

SCHEMA = "doc_id bigint, text string, lang string, source string, shard string, slice string, total string, term string, data string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, *["x"] * 5) for i, (t, g, s) in enumerate(rows)], SCHEMA)


def terms(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(rows, least=3, top=200):
    holders, counts = defaultdict(Counter), defaultdict(Counter)
    rows = [(t, g or "", s or "") for t, g, s in rows]
    for text, lang, source in rows:
        own = terms(text)
        holders[lang].update(set(own))
        counts[lang, source].update(own)
    out = []
    for lang in {g for _, g, _ in rows}:
        kept = sorted(w for w, n in holders[lang].items() if n >= least)
        sources = sorted(s for g, s in counts if g == lang)
        c = {s: [counts[lang, s][w] for w in kept] for s in sources}
        p = {s: [1 + 10**9 * (n + 1) // (sum(c[s]) + len(kept)) for n in c[s]] for s in sources}
        whole = [sum(x) for x in zip(*c.values(), strict=True)]
        q = [1 + 10**9 * (n + 1) // (sum(whole) + len(kept)) for n in whole]
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in sources if o != s]
            alone = [(f(p[s][i], q[i]), w) for i, w in enumerate(kept) if c[s][i] and p[s][i] > q[i]]
            for part, found, limit in (("pair", pairs, None), ("term", alone, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, w, v, k + 1) for k, (v, w) in enumerate(ordered)]
    return sorted(out)


def random_rows(n, seed=4):
    rng = random.Random(seed)
    words = ["Aé", "b", "c", "déjà", "漢字", "x" * 30, "X" * 31, "z" * 24, *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12))]
    pick = lambda: rng.choice(words[: rng.choice([8, 40, len(words)])])
    text = lambda: rng.choice([" ", "-", "1"]).join(pick() for _ in range(rng.randrange(60)))
    return [(text(), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s", "s", "s", "t", "Ü", None])) for _ in range(n)]


def run(spark, rows, rule=Rule()):
    return sorted(tuple(r) for r in divergence.divergences(frame(spark, rows), rule).collect())


def test_perfect_hash_is_minimal_and_refuses_other_words():
    words = [f"term{i}".encode() for i in range(5000)] + ["é".encode(), b"y" * 24, b"y" * 25, b"y" * 400]
    for perfect in (made := PerfectHash(words), PerfectHash.from_bytes(made.to_bytes())):
        data, starts, sizes = _flat(words)
        keys, lanes = hashed(data, starts, sizes)
        slots = perfect.slots(data, starts, sizes, keys, lanes)
        assert sorted(slots.tolist()) == list(range(len(words)))
        assert [perfect.words[s] for s in slots] == words
        data, starts, sizes = _flat([f"Term{i}".encode() for i in range(5000)] + [b"y" * 26, b"", b"y" * 399 + b"z"])
        keys, lanes = hashed(data, starts, sizes)
        assert (perfect.slots(data, starts, sizes, keys, lanes) == -1).all()
        # a word with the hash of a key, but other bytes, is no key
        other, o_starts, o_sizes = _flat([b"q" * len(w) for w in words])
        keys, _ = hashed(*_flat(words))
        assert (perfect.slots(other, o_starts, o_sizes, keys, hashed(other, o_starts, o_sizes)[1]) == -1).all()


def test_words_that_no_level_settles_are_kept_by_their_bytes(monkeypatch):
    monkeypatch.setattr(divergence, "LEVELS", 1)
    words = [f"term{i}".encode() for i in range(300)]
    perfect = PerfectHash.from_bytes(PerfectHash(words).to_bytes())
    data, starts, sizes = _flat([*words, b"other", b"y" * 40])
    keys, lanes = hashed(data, starts, sizes)
    slots = perfect.slots(data, starts, sizes, keys, lanes)
    assert perfect.rest and sorted(slots[:300].tolist()) == list(range(300)) and slots[300:].tolist() == [-1, -1]


def test_shares_of_very_large_counts_are_exact():
    counts = np.array([0, 5, 12_000_000_000, 700_000_000_000], np.int64)
    total = int(counts.sum())
    assert shares(counts, total, 4, Rule()).tolist() == [1 + 10**9 * (c + 1) // (total + 4) for c in counts.tolist()]


def test_rounds_hold_no_more_than_their_limit():
    sizes = [("a", 0, 5), ("a", 1, 5), ("b", 0, 30), ("c", 0, 4), ("c", 1, 6), ("c", 2, 1)]
    assert rounds(sizes, 10) == [[("a", 0), ("a", 1)], [("b", 0)], [("c", 0), ("c", 1)], [("c", 2)]]
    assert rounds([], 10) == []


@pytest.mark.parametrize("rule", [Rule(), Rule(shard_keys=20, broadcast_bytes=6000, dense_cells=64), Rule(least_docs=2, top=3, shard_keys=9)])
def test_against_plain_counts(spark, rule):
    rows = random_rows(160)
    assert run(spark, rows, rule) == plain(rows, rule.least_docs, rule.top)


def test_odd_rows(spark):
    rows = [(None, "en", "a"), ("", "en", "b"), (SENTENCE, "en", "a"), (SENTENCE, "en", "a"), (SENTENCE.upper(), "en", None), (LONG, "en", "c"), ("once", "de", "a"), ("only", "de", "b"), (None, None, None)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []
    assert run(spark, [("one two", "fr", "x")]) == []


def test_shards_are_even():
    keys, _ = hashed(*_flat([f"term{i}".encode() for i in range(20_000)]))
    sizes = np.bincount(shard_of(keys, 5))
    assert sizes.min() > 3700
