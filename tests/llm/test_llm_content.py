import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import LONG, ODD, frame
from pyspark.sql import functions as F

from controlweave.llm import decontaminate, licenses, toxicity
from controlweave.llm.queries import QUERIES

TERMS = ["idiot", "scum", "pathetic", "worthless"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_accepts_words_within_one_edit():
    rng = random.Random(2)
    automaton = toxicity.Automaton(TERMS)
    for _ in range(3000):
        word = list(rng.choice(TERMS))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "i", "x"])
        text = "".join(word)
        if not text:
            continue
        codes = automaton.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        found, states = automaton.read(codes, np.array([0]), np.array([len(text)]))
        best = min((distance(text, t), k) for k, t in enumerate(TERMS) if distance(text, t) <= (1 if len(t) >= toxicity.FUZZY_LETTERS else 0)) if any(distance(text, t) <= (1 if len(t) >= toxicity.FUZZY_LETTERS else 0) for t in TERMS) else None
        assert (len(found) > 0) == (best is not None), text
        if best:
            assert (automaton.edits[states[0]], automaton.term[states[0]]) == best


def test_context_weighs_hits():
    model = toxicity.Model(TERMS, [7.0] * 4)
    reader = toxicity.Reader(model)
    texts = ["You are an idiot!", 'The sign read "idiot" in red.', "He said that the idiot left.", "An id1ot, a (pathetic) one", "nothing here", ""]
    hits = [h for _, h in reader.hits(texts)]
    assert [[(x.term, x.found, x.edits, x.context) for x in h] for h in hits] == [
        [("idiot", "idiot", 0, "directed")], [("idiot", "idiot", 0, "quoted")], [("idiot", "idiot", 0, "reported")],
        [("idiot", "id1ot", 1, "plain"), ("pathetic", "pathetic", 0, "plain")], [], [],
    ]
    assert texts[3][hits[3][1].start :].startswith("pathetic")


def labelled(spark):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            w[5], w[30] = rng.choice(TERMS), rng.choice(TERMS)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_learns_and_scores(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert set(TERMS) <= set(model.terms)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(r.predicted == int(i % 6 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    misspelt = {r.doc_id: r for r in toxicity.score(frame(spark, [(1, "you worthles, patthetic word1 word2"), (2, "word1 word2")]), model).collect()}
    assert misspelt[1].predicted == 1 and [h.edits for h in misspelt[1].hits] == [1, 1] and misspelt[2].predicted == 0
    odd = toxicity.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(not r.held_out for r in odd if r.doc_id is None)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 500
    empty = toxicity.fit(frame(spark, []), labels)
    assert empty.terms == [] and toxicity.score(frame(spark, []), empty).count() == 0


def test_toxicity_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op3_toxicity"].run(spark, sf_dir)
    pairs = got.where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    right = sum(p == t for p, t in pairs) / len(pairs)
    caught = sum(p and t for p, t in pairs) / max(1, sum(t for _, t in pairs))
    assert got.count() == 1000 and right >= 0.93 and caught >= 0.6


def exact_leaks(spark, sf_dir):
    read = lambda n, c: spark.read.parquet(f"{sf_dir}/{n}.parquet").select(*c).collect()
    clean = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split())
    items = [(i, clean(t)) for i, t in read("benchmark", ["item_id", "text"])]
    return {(d, i) for d, t in read("documents", ["doc_id", "text"]) for c in [clean(t)] for i, x in items if x in c}


def test_decontamination_query_finds_all_exact_leaks(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontaminate"].run(spark, sf_dir).collect()}
    want = exact_leaks(spark, sf_dir)
    assert want and want <= got and len(got - want) <= 0.02 * len(got)


def test_decontamination_of_reworded_items(spark):
    sf_dir, rng = "/root/testdata/sf0.01", random.Random(4)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    host = [t.split() for _, t in docs.limit(60).collect()]
    rows = []
    for k, (i, text) in enumerate(items.select("item_id", "text").collect()):
        w = [rng.choice(host[0]) if rng.random() < 0.15 else x for x in text.split()]
        rows.append((i, " ".join([*host[k % 60][:80], *w, *host[k % 60][80:200]])))
    space = decontaminate.fit(docs)
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark, rows), items, space).collect()}
    assert sum((i, i) in got for i, _ in rows) >= 0.9 * len(rows)


def test_decontamination_odd_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "some text"), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa?  Answer forty two")], "item_id bigint, text string")
    rows = [*ODD, (50, "first Alpha, beta gamma delta epsilon zeta eta theta iota kappa? answer: forty two then")]
    got = decontaminate.matches(frame(spark, rows), items).collect()
    assert [(r.doc_id, r.item_id, r.answer_share) for r in got] == [(50, 3, 1.0)]
    assert decontaminate.matches(frame(spark, []), items).count() == 0
    assert decontaminate.matches(frame(spark, rows), items.where("false")).count() == 0


def test_scattered_words_of_an_item_are_no_leak():
    text = "what is the name of the river that runs through the old town? it is the long blue river"
    (item,) = decontaminate.read_items([(5, text)])

    class Run(decontaminate.Search):
        """One run of close windows over all of each text."""

        def __init__(self):
            self.items = [item]

        def close(self, words):
            yield from ((t, 0, 0, int(n)) for t, n in enumerate(np.diff(words.first)))

    filler = lambda k, n: [f"x{k}{i}" for i in range(n)]
    clean = " ".join(w for k, part in enumerate(text.split()) for w in [part, *filler(k, 40)])
    for before in range(0, 60, 7):
        held = " ".join(filler("a", 300 + before) + text.split() + filler("b", 300))
        found = list(Run().confirmed(decontaminate.Words([clean.encode(), held.encode()], marks=True)))
        assert [(t, i, share, answer) for t, i, share, answer, *_ in found] == [(1, 5, 1.0, 1.0)]
        assert found[0][5] == 300 + before + len(item.words)


@pytest.mark.parametrize("seed", range(3))
def test_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(8) for _ in range(rng.randrange(1, 70))] for _ in range(2))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontaminate.common_subsequence(decontaminate._places(a), b, len(a))[0] == table[-1][-1]


def test_licences(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    rows = [
        *ODD, (20, "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore."), (21, "This work is licensed under the GNU General Public License, version 3."),
        (22, "Copyright (c) 2020 A. Person\n\n" + mit.replace("sublicense, and/or", "and/or").replace(". THE", ".\n\nTHE")),
        (23, "Licensed under the Apache License, Version 7.0."), (24, "a licence to drive was never granted to this person or any other"),
        (25, "Released under the MIT License.\nplain\nLicensed under CC BY-NC 4.0."),
    ]
    got = licenses.notices(frame(spark, rows)).collect()
    found = sorted((r.doc_id, r.licence or "", r.exact) for r in got)
    assert found == [(20, "Apache-2.0", True), (21, "GPL-3.0", True), (22, "MIT", False), (23, "", False), (24, "", False), (25, "CC-BY-NC-4.0", True), (25, "MIT", True)]
    changed = next(r for r in got if r.doc_id == 22)
    assert changed.missing == ["sublicense"] and changed.added == [] and changed.first_line == 0
    assert licenses.notices(frame(spark, [])).count() == 0


def test_notices_in_long_lines_and_lists():
    apache, bsd, mit = (licenses.TEMPLATES[n][0] for n in ("Apache-2.0", "BSD-3-Clause", "MIT"))
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 9))) + rng.choice(["", " of the", " under", " and"]) for _ in range(n))
    for n in (20, 60, 200, 2000):
        got = scanner.scan(f"{prose(n)}. {apache} {prose(n)}")
        assert [(g.licence, g.exact) for g in got] == [("Apache-2.0", True)], n
        changed = scanner.scan(f"{prose(n)} {licenses.TEMPLATES['GPL-3.0'][1].replace('redistribute it and/or', 'redistribute it or')} {prose(n)}")
        assert [(g.licence, g.missing) for g in changed] == [("GPL-3.0", ("and",))], n
    full = licenses.TEMPLATES["MIT"][2]
    beside = {g.licence for g in scanner.scan(f"{full}\n{bsd}\n{full}")}
    assert beside == {"MIT", "BSD-3-Clause"}
    every = "\n".join(w for wordings in licenses.TEMPLATES.values() for w in wordings)
    listed = scanner.scan(every)
    assert {g.licence for g in listed} == set(licenses.TEMPLATES) and all(g.exact for g in listed)
    both = scanner.scan(f"{licenses.TEMPLATES['GPL-2.0'][1]} {prose(50)} {licenses.TEMPLATES['GPL-3.0'][1]} {mit}")
    assert sorted(g.licence for g in both) == ["GPL-2.0", "GPL-3.0", "MIT"] and all(g.exact for g in both)
    assert [g.licence for g in scanner.scan(prose(300) + " licence")] == [None]


def test_licences_that_hardly_differ():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    every = [(name, w) for name, wordings in licenses.TEMPLATES.items() for w in wordings]
    for name, wording in every:
        for text in (wording, wording.upper(), f"Copyright 2019 A. Person. {wording} See also the file NOTICE."):
            assert [(g.licence, g.exact) for g in scanner.scan(text)] == [(name, True)], text
    for text in ("It is not released under the MIT License.", "This was never licensed under the MIT License.", "Not licensed under CC BY 4.0."):
        assert [g.licence for g in scanner.scan(text)] == [None], text
    # a distinguishing word more or less is no confirmation of the other licence
    agpl, lgpl, mit0 = licenses.TEMPLATES["AGPL-3.0"][1], licenses.TEMPLATES["LGPL-2.1"][1], licenses.TEMPLATES["MIT-0"][2]
    few = licenses.Scanner({k: v for k, v in licenses.TEMPLATES.items() if k in ("GPL-2.0", "GPL-3.0", "MIT")})
    assert [g.licence for g in few.scan(agpl)] == [None] == [g.licence for g in few.scan(lgpl)]
    assert [g.licence for g in few.scan(mit0)] == [None]
    assert [g.licence for g in few.scan("Licensed under the MIT-0 License.")] == [None]
    changed = scanner.scan(agpl.replace("redistribute it and/or", "redistribute it or"))
    assert [(g.licence, g.exact, g.missing) for g in changed] == [("AGPL-3.0", False, ("and",))]


def test_the_compressor_decides(monkeypatch):
    """Both wordings would be confirmed; the one that saves more bytes wins, in any order of the templates."""
    first = "the holder of this work grants everyone the right to copy and change it for any purpose without any fee"
    second = first.replace("everyone", "whomsoever")
    for templates in ({"A": (first,), "B": (second,)}, {"B": (second,), "A": (first,)}):
        assert [(g.licence, g.exact) for g in licenses.Scanner(templates).scan(second)] == [("B", True)]
        assert [(g.licence, g.exact) for g in licenses.Scanner(templates).scan(first)] == [("A", True)]
    monkeypatch.setattr(licenses.Template, "saved", lambda self, words: (10, 20))
    assert [g.licence for g in licenses.Scanner({"A": (first,), "B": (second,)}).scan(second)] == ["A"]
    monkeypatch.setattr(licenses.Template, "saved", lambda self, words: (10 if words == self.words else 0, 20))
    assert [g.licence for g in licenses.Scanner({"A": (first,), "B": (second,)}).scan(f"and so on {second} and so on")] == [None]


def test_very_long_texts_are_scanned_whole(spark):
    filler = "plain words of prose without a cue\n" * 40_000
    rows = [(1, f"{filler}Released under the MIT License.\n{filler}Licensed under the ISC License.\n{filler}")]
    got = sorted((r.first_line, r.licence) for r in licenses.notices(frame(spark, rows)).collect())
    assert got == [(40_000, "MIT"), (80_001, "ISC")]


def test_licence_query_against_plain_search(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.first_line, r.licence) for r in QUERIES["op10_licenses"].run(spark, sf_dir).collect()}
    lines = {w: name for name, wordings in licenses.TEMPLATES.items() for w in wordings}
    want = {(d, i, lines[x]) for d, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() for i, x in enumerate((t or "").split("\n")) if x in lines}
    assert want and got == want


def test_space_is_fitted_on_every_passage(spark, monkeypatch):
    """More passages than the former sample took: each counts once in each step."""
    read, sketched = [], decontaminate._sketched

    def counting(idf, basis):
        run = sketched(idf, basis)
        accumulator = spark.sparkContext.accumulator(0)
        read.append(accumulator)

        def step(batches):
            def counted():
                for part in batches:
                    accumulator.add(sum(len(s) for s in part.column(0).to_pylist()))
                    yield part

            return run(counted())

        return step

    monkeypatch.setattr(decontaminate, "_sketched", counting)
    # texts of one letter: a passage and a byte each
    docs = spark.range(250_000).select(F.col("id").alias("doc_id"), F.char(97 + F.col("id") % 26).alias("text"))
    decontaminate.fit(docs.union(spark.createDataFrame([(None, None), (1, "")], "doc_id bigint, text string")))
    assert [a.value for a in read] == [250_000, 250_000]


def _table(parts, shape):
    out = np.zeros(shape)
    for r in parts.to_pylist():
        rows = r["block"] * decontaminate._ROWS + np.frombuffer(r["rows"], "<u2").astype(int)
        out[rows] += np.frombuffer(r["values"], np.float32).reshape(len(rows), -1)
    return out


def test_a_task_sends_the_rows_of_its_features_only():
    """Many tasks of few texts: what they send follows from their words, not from the number of features."""
    idf, basis = np.ones(decontaminate.FEATURES), np.random.default_rng(5).standard_normal((decontaminate.FEATURES, 5), np.float32)
    sketch = decontaminate._sketched(idf, basis)
    sent = []
    for text in ("one two three", "three four", "", "five " * 40):
        sent += sketch(decontaminate._terms([pa.record_batch([pa.array([text.encode()])], names=["text"])]))
    assert len(sent) == 3
    assert sum(len(v) for part in sent for v in part.column("values").to_pylist()) == 6 * basis.shape[1] * 4
    together = pa.Table.from_batches(sent).combine_chunks()
    blocks = {}
    for part in together.to_batches():
        for k in range(part.num_rows):
            blocks.setdefault(part.column("block")[k].as_py(), []).append(part.slice(k, 1))
    added = [out for k, parts in blocks.items() for out in decontaminate._added((pa.scalar(k),), iter(parts))]
    np.testing.assert_allclose(_table(pa.Table.from_batches(added), basis.shape), _table(together, basis.shape), rtol=1e-6)


def test_sums_of_passages_against_plain_matrices(monkeypatch):
    """Rows of texts are worked on together; features of many passages are summed in pieces."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "of", *(f"w{rng.randrange(400)}" for _ in range(6))]) for _ in range(rng.randrange(1, 90))).encode() for _ in range(300)]
    parts = [pa.record_batch([pa.array(texts[at : at + 7], pa.binary())], names=["text"]) for at in range(0, len(texts), 7)]
    terms = list(decontaminate._terms(parts))
    idf = np.random.default_rng(4).random(decontaminate.FEATURES) + 0.5
    basis = np.random.default_rng(5).standard_normal((decontaminate.FEATURES, 5), np.float32)
    rows = []
    for sizes, features, counts in decontaminate._read_terms(terms):
        for feature, count in zip(np.split(features, np.cumsum(sizes)[:-1]), np.split(counts, np.cumsum(sizes)[:-1]), strict=True):
            row = np.zeros(decontaminate.FEATURES)
            row[feature] = (1 + np.log(count.astype(float))) * idf[feature]
            rows.append(row / np.linalg.norm(row))
    want = np.array(rows).T @ (np.array(rows) @ basis)
    for together in (1, 100, 1 << 15):
        monkeypatch.setattr(decontaminate, "TOGETHER", together)
        made, weighed = [], decontaminate._weighed
        with monkeypatch.context() as patch:
            patch.setattr(decontaminate, "_weighed", lambda *a: made.append(1) or weighed(*a))
            (got,) = decontaminate._sketched(idf, basis)(iter(terms))
        values = _table(got, want.shape)
        np.testing.assert_allclose(values, want, rtol=1e-4, atol=1e-4)
    assert len(made) == 2  # one sum over all passages, one over all features
    assert np.count_nonzero(np.array(rows), axis=0).max() > decontaminate.WIDTH


def test_sums_of_passages_hold_little_memory():
    """What is prepared for the small products covers some entries at a time, not all that are worked on together."""
    rng = np.random.default_rng(7)
    n, each = decontaminate.TOGETHER, 24
    features = np.sort(rng.integers(0, decontaminate.FEATURES, (n, each)).astype("<u2"), axis=1)
    part = pa.record_batch([pa.array([np.full(n, each, np.uint8).tobytes()]), pa.array([features.tobytes()]), pa.array([np.ones(n * each, np.uint8).tobytes()])], schema=decontaminate._TERMS)
    idf, basis = rng.random(decontaminate.FEATURES) + 0.5, rng.standard_normal((decontaminate.FEATURES, decontaminate.SKETCH), np.float32)
    tracemalloc.start()
    try:
        (got,) = decontaminate._sketched(idf, basis)(iter([part]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.num_rows == decontaminate.FEATURES // decontaminate._ROWS
    assert peak < 80e6


def test_blocks_of_windows_are_summed_as_before():
    """Sums of up to BLOCK vectors, to the bit those of numpy's reduceat, over more blocks than one round takes."""
    rng = np.random.default_rng(4)
    table = rng.standard_normal((decontaminate.FEATURES, 48)).astype(np.float32)
    texts = [" ".join(f"w{rng.integers(9000)}" for _ in range(n)).encode() for n in (0, 1, 7, 8, 9, 64, 0, 30_001, 3)]
    words = decontaminate.Words(texts, marks=True)
    features = decontaminate._features(words)
    starts = np.concatenate([np.arange(a, b, decontaminate.BLOCK) for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
    ends = np.concatenate([np.minimum(np.arange(a, b, decontaminate.BLOCK) + decontaminate.BLOCK, b) for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
    got = decontaminate.Search(decontaminate.Space(table), [], 0.6)._block_sums(features, starts, ends - starts)
    assert np.array_equal(got, np.add.reduceat(table[features], starts, axis=0))


def test_stretches_without_an_items_words_are_not_aligned(monkeypatch):
    """Only stretches that hold enough of an item's words are aligned with it; what is found stays."""
    rng = np.random.default_rng(6)
    item = " ".join(f"i{k}" for k in range(30)) + "? answer here"
    texts = [" ".join(f"w{rng.integers(500)}" for _ in range(600)).encode() for _ in range(3)]
    texts.append(b" ".join([texts[0][:900], item.encode(), texts[1][:700]]))
    words = decontaminate.Words(texts, marks=True)
    space = decontaminate.Space(rng.standard_normal((decontaminate.FEATURES, 48)).astype(np.float32))
    search = decontaminate.Search(space, decontaminate.read_items([(5, item)]), -1.0)  # every window is close
    aligned, plain = [], decontaminate._ordered
    monkeypatch.setattr(decontaminate, "_ordered", lambda hits, length: aligned.append(len(hits)) or plain(hits, length))
    found = list(search.confirmed(words))
    begin = len(decontaminate.Words([texts[0][:900]], marks=True).hashes)
    assert [(f[:4]) for f in found] == [(3, 5, 1.0, 1.0)] and found[0][4:] == (begin, begin + 32)
    assert 0 < len(aligned) <= 12
