import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ODD, SENTENCE, frame

from controlweave.llm import suffix_buckets
from controlweave.llm.suffix_buckets import Rule, bucket_pointers
from controlweave.llm.tables import release_shuffles


def plain(rows, length=50):
    """(id, bytes, spans, kept) by a table of all strings."""
    first = {}
    later = float("inf")
    own = [(later if i is None else i, (t or "").encode()) for i, t in rows]
    for i, text in own:
        for k in range(len(text) - length + 1):
            s = text[k : k + length]
            first[s] = min(first.get(s, later), i)
    out = []
    for (i, text), (doc_id, _) in zip(own, rows, strict=True):
        gone = np.zeros(len(text) + 2, bool)
        for k in range(len(text) - length + 1):
            if first[text[k : k + length]] < i:
                gone[k + 1 : k + length + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        spans = list(zip(edges[0::2], edges[1::2], strict=True))
        out.append((doc_id, len(text), spans, bytes(c for c, g in zip(text, gone[1:], strict=False) if not g)))
    return sorted(out, key=str)


def cut(spark, rows, **rule):
    got = suffix_buckets.remove_repeats(frame(spark, rows), Rule(**rule)).collect()
    return sorted(((r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in got), key=str)


def quoting(rng, n):
    """Texts of a small alphabet that quote one another, with repeats inside, at any offset."""
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(30, 160))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.append(rng.choice([p, p[a:], p[:a], p + p, "x" * rng.randrange(120), "".join(rng.choice("abc ") for _ in range(40))]))
        texts.append("".join(parts))
    return texts


def test_buckets_of_suffixes_are_those_of_sorting():
    rng = random.Random(1)
    for length in (24, 31, 50, 64, 100):
        texts = [t.encode() for t in quoting(rng, 12)] + [b"z" * 300, b"", b"zzz"]
        data = np.frombuffer(b"".join(texts), np.uint8)
        end = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
        got = bucket_pointers(data, end, length)
        starts = [p for p in range(len(data)) if p + length <= end[p]]
        strings = {p: data[p : p + length].tobytes() for p in starts}
        by_string = {}
        for p in starts:
            by_string.setdefault(strings[p], set()).add(int(got[p]))
        assert all(len(v) == 1 for v in by_string.values())
        names = [by_string[s].pop() for s in sorted(by_string)]
        assert names == sorted(set(names))  # distinct, and in the order of the strings


@pytest.mark.parametrize("rule", [{}, {"block_bytes": 300, "hot_blocks": 3}, {"block_bytes": 900, "hot_blocks": 2, "length": 37}])
def test_against_all_strings(spark, rule):
    rng = random.Random(7)
    texts = quoting(rng, 90)
    ids = list(range(90))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(500 + i, texts[0] + SENTENCE) for i in range(25)] + [(3, texts[5]), (None, texts[9]), (None, None)]
    assert cut(spark, rows, **rule) == plain(rows, rule.get("length", 50))


def test_odd_rows(spark):
    assert cut(spark, ODD) == plain(ODD)
    assert cut(spark, []) == []
    alone = [(1, ""), (2, None), (3, "short")]
    assert cut(spark, alone) == plain(alone)


def test_parts_of_a_long_text(spark, monkeypatch):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, "head " + shared), (2, shared[100:4000] + " between " + shared), (3, "".join(rng.choice("abcdefgh ") for _ in range(6000)) + shared[7:300])]
    monkeypatch.setattr(suffix_buckets, "PART_BYTES", 700)
    blocks = [{"ids": [i], "sizes": [len(t)], "data": suffix_buckets._squeezed(t.encode())} for i, t in rows]
    runs = [suffix_buckets.Block(b, Rule(), 4).runs for b in blocks]
    for (_, text), r in zip(rows, runs, strict=True):
        assert r["count"].sum() == len(text) - 49 and (np.diff(r["begin"]) == r["count"][:-1]).all()
    # equal windows have equal anchors
    anchor = [np.repeat(r["anchor"], r["count"]) for r in runs]
    assert (anchor[0][5 : 5 + 4951] == anchor[1][3909 : 3909 + 4951]).all() and (anchor[0][105:3000] == anchor[1][:2895]).all()


def test_query_digests(spark):
    from controlweave.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op12_suffix_buckets"].run(spark, sf_dir).collect()}
    for doc_id, n, spans, kept in plain(rows):
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, sum(b - a for a, b in spans), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert len(got) == len(rows)


def test_pieces_are_let_go_when_judged(spark, monkeypatch):
    """The last step reads what the buckets answered, not the buckets' shuffle, whose files may go before it runs."""
    released = []
    monkeypatch.setattr(suffix_buckets, "release_shuffles", lambda session: released.append(session))
    same = "a stretch of bytes that two documents hold, longer than fifty bytes"
    cut = suffix_buckets.remove_repeats(spark.createDataFrame([(1, "x" + same), (2, "y" + same), (3, None)], "doc_id bigint, text string"))
    assert "FlatMapGroupsInArrow" not in cut._jdf.queryExecution().toString()
    assert len(released) == 2
    assert {r.doc_id: bytes(r.kept) for r in cut.collect()} == {1: ("x" + same).encode(), 2: b"y", 3: b""}


def test_buckets_are_ordered_as_their_bytes():
    """A bucket and what follows are sorted as one number."""
    rng = np.random.default_rng(6)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    end = np.repeat([700, 711, 1500, 3000], [700, 11, 789, 1500])
    pointer = suffix_buckets.bucket_pointers(data, end, 50)
    names = {}
    for at in range(len(data)):
        if at + 50 <= end[at]:
            assert names.setdefault(data[at : at + 50].tobytes(), pointer[at]) == pointer[at]
    assert len(set(names.values())) == len(names)
    assert sorted(names, key=names.get) == sorted(names)


def test_windows_are_looked_at_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_buckets, "RUN_BYTES", 700)
    test_parts_of_a_long_text(spark, monkeypatch)


def test_shuffles_of_the_latest_write_are_released(spark, tmp_path):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    def settled(most):
        until = time.time() + 5
        while files() > most and time.time() < until:
            time.sleep(0.2)
        return files()

    release_shuffles(spark)
    before = settled(0)
    spark.range(0, 1000, 1, 4).repartition(3, "id").write.parquet(str(tmp_path / "rows"))
    assert files() > before
    release_shuffles(spark)
    assert settled(before) <= before


def sent(texts, rule=Rule()):
    """The pieces that blocks of one text each send, after they have exchanged their anchors."""
    rows = [{"block": i, "ids": [i], "sizes": [len(t)], "data": suffix_buckets._squeezed(t)} for i, t in enumerate(texts)]
    parts = [pa.RecordBatch.from_pylist([r], pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])) for r in rows]
    asked = [r for part in suffix_buckets._anchors(rule, 2)(parts) for r in part.to_pylist()]
    met = []
    for bucket in (0, 1):
        own = [r for r in asked if r["bucket"] == bucket]
        if own:
            met += [r for part in suffix_buckets._met(rule)((pa.scalar(bucket),), iter([pa.RecordBatch.from_pylist(own, suffix_buckets._ANCHORS)])) for r in part.to_pylist()]
    return [suffix_buckets.Runs(suffix_buckets.Block(r, rule, 2), [m for m in met if m["block"] == r["block"]]).contents for r in rows]


def test_anchors_that_stand_among_other_bytes_are_not_sent():
    """Of an anchor in several texts, only windows whose bytes before or behind it are shared too may repeat."""
    rng = random.Random(11)
    noise = lambda n: bytes(rng.randrange(33, 127) for _ in range(n))
    short, long = noise(34), noise(50)
    assert not any(sent([noise(200) + short + noise(200) for _ in range(40)]))
    pieces = sent([noise(200) + long + noise(200) for _ in range(40)])
    assert all(any(long in p for p in own) for own in pieces)


@pytest.mark.parametrize("length", [24, 25, 37, 50, 90])
def test_lengths_and_hot_anchors_against_all_strings(spark, length):
    rng = random.Random(length)
    rows = [(i, "".join(rng.choice("ab") * rng.randrange(1, 60) + str(rng.randrange(3)) for _ in range(rng.randrange(0, 14)))) for i in range(24)]
    rows = [(i, t + ("" if i % 3 else rows[rng.randrange(24)][1])) for i, t in rows]
    for hot in (2, 256):
        assert cut(spark, rows, length=length, hot_blocks=hot, block_bytes=300) == plain(rows, length)
