import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from llm_cases import ODD, frame

from controlweave.llm import resampling
from controlweave.llm.resampling import Features, Pieces, Rule, SlotTable, joined_crc, xxh64


def features(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(rows, target):
    """The result by counting feature by feature."""
    s = Counter(bucket(f) for _, t in rows for f in features(t)[0])
    t = Counter(bucket(f) for x in target for f in features(x)[0])
    n_s, n_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * n_s / ((s[b] + 1.0) * n_t))) for b in range(10_000)]
    out = []
    for i, text in rows:
        own, n_words = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    drawn = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(drawn[: len(drawn) * 5 // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def test_lanes_hash_as_the_library():
    lanes = [np.array([1, 2, 1 << 63], np.uint64), np.array([7, 0, 3], np.uint64)]
    want = [xxhash.xxh64_intdigest(np.array(x, "<u8").tobytes(), seed=9) for x in zip(*lanes, strict=True)]
    assert xxh64(lanes, 9).tolist() == want


def test_joined_crcs():
    rng = random.Random(3)
    parts = [(rng.randbytes(rng.randrange(40)), rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 4000]))) for _ in range(300)]
    a, b = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    got = joined_crc(a, b, np.array([len(p[1]) for p in parts]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in parts]


def test_equal_keys_with_other_content_have_other_slots():
    keys = np.zeros(500, np.uint64)
    content = np.arange(500, dtype=np.uint64) % np.uint64(100)
    table = SlotTable(keys, [content])
    assert len(set(table.slot.tolist())) == 100 and (table.count[table.used] == 5).all()
    assert len(set(zip(table.slot.tolist(), content.tolist(), strict=True))) == 100


def test_pieces_count_as_whole_texts():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Aé", "b", "C3", "x" * 30, "X" * 30, "漢字" * 20, "--", "d.e"]) for _ in range(rng.randrange(400))).encode() for _ in range(30)]
    for limit in (7, 64, 1000, 1 << 20):
        total, n = Counter(), Counter()
        for group in Pieces(texts, 3, limit):
            made = Features(group, Rule())
            for (table, slots), owner in zip(made.tables, made.owners, strict=True):
                total.update(dict(zip(table.bucket[table.used].tolist(), [0] * len(table.used), strict=True)))
                for b, c in zip(table.bucket[table.used].tolist(), table.count[table.used].tolist(), strict=True):
                    total[b] += c
                assert np.bincount(slots, minlength=len(table.holder)).tolist() == table.count.tolist()
                n.update(owner.tolist())
        assert +total == Counter(bucket(f) for t in texts for f in features(t.decode())[0])
        assert n == Counter({i: len(features(t.decode())[0]) for i, t in enumerate(texts) if features(t.decode())[0]})


def test_odd_rows(spark):
    rows = [(i, t) for i, t in ODD]
    many = [(100 + i, f"{t} {' '.join(f'extra{i * k}' for k in range(1, 15))}") for i, (_, t) in enumerate([(1, "the old river bank"), (2, "")] * 40)]
    rows += many + [(i, t) for i, t in many[:7]]
    target = ["seven grey herons watch the old river", None, "", "extra4 extra8"]
    got = resampling.resample(frame(spark, rows), frame(spark, list(enumerate(target))))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, target)
    assert resampling.resample(frame(spark, []), frame(spark, [])).count() == 0
    assert sorted((tuple(r) for r in resampling.resample(frame(spark, rows), frame(spark, [])).collect()), key=str) == plain(rows, [])
