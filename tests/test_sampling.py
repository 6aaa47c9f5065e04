"""Samples: exact sizes, repeatable choices, copies, hot strata."""

import hashlib
from collections import Counter

import pytest

from controlweave.operators import sampling
from controlweave.plans.run import population, report
from controlweave.plans.spec import Sampling

from helpers import catalog, control, frame, match, values

COPIES = [("hot", 1)] * 400 + [("cold", i) for i in range(600)]


def md5_draw(*fields, seed=42):
    parts = ["-" if f is None else f"{len(str(f))}:{f}" for f in fields]
    return hashlib.md5("#".join([*parts, str(seed)]).encode()).hexdigest()


def lowest(rows, n, seed=42):
    return Counter(sorted(rows, key=lambda r: md5_draw(*r, seed=seed))[:n])


def drawn(spark, rows, schema, parts=4, **plan):
    cat = catalog(t=frame(spark, schema, rows).repartition(parts))
    spec = control("t", sampling={"enabled": True, **plan})
    return [tuple(r) for r in population(spec, cat).frame.collect()]


@pytest.mark.parametrize("n", [1, 10, 500, 999, 1000, 5000])
def test_fixed_size_is_exact_even_among_copies(spark, n):
    got = drawn(spark, COPIES, "k string, v int", method="random", sample_size=n)
    assert Counter(got) == lowest(COPIES, n)


def test_cut_inside_a_hot_group_of_copies(spark, monkeypatch):
    """The cut-off falls among 400 identical rows, written out in small blocks."""
    monkeypatch.setattr(sampling, "COPY_BLOCK", 7)
    below = sum(md5_draw(*r) < md5_draw("hot", 1) for r in COPIES)
    got = drawn(spark, COPIES, "k string, v int", method="random", sample_size=below + 123)
    assert Counter(got)[("hot", 1)] == 123
    assert Counter(got) == lowest(COPIES, below + 123)


def test_rows_that_share_a_key_stay_together_at_every_size(spark):
    rows = [(i // 3, i) for i in range(3000)]
    for n in (4, 1999, 2000, 2002):
        got = drawn(spark, rows, "k int, v int", method="random", sample_size=n, sample_key=["k"])
        assert n <= len(got) < n + 3 and set(Counter(k for k, _ in got).values()) == {3}


def test_a_map_column_is_no_obstacle(spark):
    rows = [(i, {"a": str(i)}) for i in range(50)]
    for more in ({}, {"sample_key": ["k"]}):
        got = drawn(spark, rows, "k int, m map<string,string>", method="random", sample_size=7, **more)
        assert len({k for k, _ in got}) == 7


def test_partitioning_does_not_matter(spark):
    rows = [(i, f"r{i}") for i in range(300)]
    one = drawn(spark, rows, "k int, v string", parts=1, method="random", sample_size=40)
    many = drawn(spark, rows, "k int, v string", parts=9, method="random", sample_size=40)
    other = drawn(spark, rows, "k int, v string", method="random", sample_size=40, random_seed=7)
    assert sorted(one) == sorted(many) != sorted(other)
    assert Counter(other) == lowest(rows, 40, seed=7)


def test_nulls_and_separators_give_different_draws(spark):
    rows = [("a", None), (None, "a"), ("a#1:b", None), ("a", "b"), ("-", None)]
    assert len({md5_draw(*r) for r in rows}) == len(rows)
    got = drawn(spark, rows, "a string, b string", method="random", sample_size=3)
    assert Counter(got) == lowest(rows, 3)


@pytest.mark.parametrize("share, size", [(0.29, 290), (0.005, 5), (0.0004, 0), (1.0, 1000)])
def test_percentage_is_rounded_not_cut(spark, share, size):
    got = drawn(spark, COPIES, "k string, v int", method="random", sample_percentage=share)
    assert len(got) == size


def test_stratified_is_proportional_with_null_and_tiny_strata(spark):
    rows = [(i, "big") for i in range(700)] + [(i, "small") for i in range(700, 990)]
    rows += [(i, None) for i in range(990, 999)] + [(999, "one")]
    got = drawn(spark, rows, "k int, s string", method="stratified", sample_size=100,
                stratification_field="s", sample_key=["k"])
    assert Counter(s for _, s in got) == {"big": 69, "small": 29, None: 1, "one": 1}
    for stratum in ("big", "small", None, "one"):
        members = [r for r in rows if r[1] == stratum]
        chosen = sorted(members, key=lambda r: md5_draw(r[0]))[: sum(s == stratum for _, s in got)]
        assert sorted(r for r in got if r[1] == stratum) == sorted(chosen)


@pytest.mark.parametrize("n", [5, 7, 101, 103, 500])
def test_stratified_size_is_kept(spark, n):
    rows = [(i, "abcde"[i % 5]) for i in range(500)]
    got = drawn(spark, rows, "k int, s string", method="stratified", sample_size=n, stratification_field="s", sample_key=["k"])
    sizes = Counter(s for _, s in got)
    assert len(got) == n and max(sizes.values()) - min(sizes.values()) <= 1


def test_stratified_copies(spark):
    rows = [("a", 1)] * 90 + [("b", i) for i in range(10)]
    got = drawn(spark, rows, "s string, v int", method="stratified", sample_percentage=0.5, stratification_field="s")
    assert Counter(s for s, _ in got) == {"a": 45, "b": 5}


@pytest.mark.parametrize("size, seed", [(10, 0), (10, 13), (7, 3), (100, 1)])
def test_systematic_takes_every_kth(spark, size, seed):
    rows = [(i * 3 % 101, f"r{i}") for i in range(101)]
    got = drawn(spark, rows, "k int, v string", method="systematic", sample_size=size, sample_key=["k"],
                random_seed=seed or None)
    step = max(1, 101 // size)
    if seed:
        ranks = [r for r in range(101) if r % step == seed % step and r // step < size]
        assert sorted(k for k, _ in got) == ranks
    assert len(got) == size


def test_systematic_numbers_copies(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPY_BLOCK", 9)
    got = drawn(spark, COPIES, "k string, v int", method="systematic", sample_percentage=0.1, random_seed=3)
    ordered = sorted(COPIES)
    assert Counter(got) == Counter(ordered[3::10])


def test_judgmental_keeps_picked_rows_once(spark):
    cat = catalog(
        t=frame(spark, "id int, v string", [(1, "a"), (2, "b"), (3, "c"), (None, "d")]),
        picks=frame(spark, "id int", [(3,), (1,), (3,), (8,), (None,)]),
    )
    plan = {"enabled": True, "method": "judgmental", "sample_key": ["id"], "selection_dataset": "picks"}
    assert values(population(control("t", sampling=plan), cat).frame, "id") == [(1,), (3,)]


@pytest.mark.parametrize(
    "rows, more, size",
    [(1000, {}, 278), (50, {}, 45), (1000, {"max_sample_size": 100}, 100), (10, {"min_sample_size": 60}, 10),
     (1000, {"precision": 0.1, "confidence_level": 0.9}, 64)],
)
def test_statistical_size(spark, rows, more, size):
    data = [(i,) for i in range(rows)]
    assert len(drawn(spark, data, "k int", method="statistical", sample_key=["k"], **more)) == size


def test_sample_is_of_the_filtered_population_and_rated_over_it(spark):
    cat = catalog(t=frame(spark, "k int, v int", [(i, i % 2) for i in range(200)]))
    spec = control("t", [{"operation": "filter", "filter_expression": "k < 100"}], [match("v", "eq", 0)],
                   {"enabled": True, "method": "random", "sample_size": 20, "sample_key": ["k"]})
    row = report([spec], cat).first()
    picked = population(spec, cat).frame.collect()
    assert {r.k < 100 for r in picked} == {True}
    odd = sum(r.v for r in picked)
    assert (row.total_population, row.sampled_population, row.exception_count) == (100, 20, odd)
    assert row.exception_rate_percent == odd / 20 * 100


def test_without_a_seed_a_new_sample_is_drawn(spark):
    df = frame(spark, "k int", [(i,) for i in range(2000)])
    draws = set()
    for _ in range(3):
        plan = Sampling(enabled=True, sample_size=5, random_seed=None, sample_key=("k",))
        spec = control("t", sampling={"enabled": True, "sample_size": plan.sample_size, "random_seed": None})
        draws.add(tuple(sorted(r.k for r in population(spec, catalog(t=df)).frame.collect())))
    assert len(draws) > 1


def test_a_sample_is_read_from_its_candidates(spark, tmp_path):
    """Once drawn, neither rows nor metrics read the population again."""
    from helpers import plan

    path = str(tmp_path / "t")
    spark.range(5000).selectExpr("id AS k", "id % 5 AS s").write.parquet(path)
    for method, more in (("random", {}), ("stratified", {"stratification_field": "s"})):
        spec = control("t", sampling={"enabled": True, "method": method, "sample_size": 300, "sample_key": ["k"], **more})
        picked = population(spec, catalog(t=spark.read.parquet(path))).frame
        assert "FileScan" not in plan(picked, "simple") and picked.count() == 300


def test_systematic_ranks_of_copies_by_arithmetic(spark, monkeypatch):
    """Any step and start over rows of which many are copies; only distinct rows are checkpointed."""
    stored, kind = [], type(spark.range(1))
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: stored.append(real(self, *a, **k)) or stored[-1])
    rows = [("a", 1)] * 37 + [("b", None)] * 5 + [("c", i) for i in range(20)] + [("d", 2)] * 90
    ordered = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    for size, seed in ((10, 1), (7, 5), (152, 3), (1, 140), (500, 2), (33, 9)):
        got = drawn(spark, rows, "k string, v int", method="systematic", sample_size=size, random_seed=seed)
        step = max(1, len(rows) // size)
        assert Counter(got) == Counter(ordered[seed % step :: step][:size])
    assert {s.count() for s in stored} == {23}
    monkeypatch.undo()
    assert drawn(spark, [], "k string, v int", method="systematic", sample_size=3, random_seed=1) == []
