"""The predicate index counts what conditional aggregates count, and coverings lose no row."""

import random
import re
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from controlweave.operators.names import Lineage
from controlweave.operators.population import build_joined
from controlweave.plans import metrics
from controlweave.plans.metrics import indexed_metrics, members_of, row_metrics
from controlweave.plans.predicates import _merged, _ranges, Atom, atom_of, covering
from controlweave.plans.run import report
from controlweave.plans.spec import FilterComparison

from helpers import catalog, control, frame, join, keep, keep_in, keep_null, match, plan, rule, values

SCHEMA = "id int, who string, amount double, small smallint, cents decimal(9,2), seen timestamp_ntz, day date, flag boolean, rate float, other bigint"
T0 = datetime(2024, 1, 1)


def rows(n=400, seed=1):
    rng = random.Random(seed)
    some = lambda make: None if rng.random() < 0.1 else make()
    return [
        (
            i, some(lambda: rng.choice(["a", "A", " a ", "b", "", "ß", "ss", "Émile"])),
            some(lambda: rng.choice([0.0, -0.0, float("nan"), float("inf"), -1.5, 0.1, 2.0, 3.0, 7.25])),
            some(lambda: rng.randrange(-5, 6)), some(lambda: Decimal(rng.randrange(900)).scaleb(-2)),
            some(lambda: T0 + timedelta(hours=rng.randrange(100))), some(lambda: date(2024, 1, 1) + timedelta(days=rng.randrange(5))),
            some(lambda: rng.random() < 0.5), some(lambda: rng.choice([0.1, 1.0, 2.5])), some(lambda: rng.choice([2**53, 2**53 + 1, -7, 12])),
        )
        for i in range(n)
    ]


def random_controls(n, seed=2):
    rng = random.Random(seed)
    ops = ["eq", "neq", "gt", "lt", "gte", "lte"]
    filters = [
        lambda: keep("amount", rng.choice(ops), rng.choice([0, 0.1, 2, 3.5])),
        lambda: keep("small", rng.choice(ops), rng.choice([-2, 0, 3, 2.5])),
        lambda: keep("other", rng.choice(ops), rng.choice([2**53 + 1, 2.0**53, 0])),
        lambda: keep("who", rng.choice(["eq", "neq"]), rng.choice(["a", "b", ""])),
        lambda: keep_in("who", *rng.sample(["a", "A", "b", "zz"], 2)),
        lambda: keep_in("small", *rng.sample(range(-3, 4), 3)),
        lambda: keep("seen", rng.choice(ops), T0 + timedelta(hours=rng.randrange(100))),
        lambda: keep("day", rng.choice(ops), date(2024, 1, rng.randrange(1, 7))),
        lambda: keep_null(rng.choice(["who", "amount", "seen", "flag"]), rng.random() < 0.5),
        lambda: keep("cents", rng.choice(ops), 4.5),
        lambda: keep("rate", rng.choice(ops), 0.1),
        lambda: {"operation": "filter", "filter_expression": f"small % {rng.randrange(2, 4)} = 0 OR amount > 1"},
    ]
    rules = [
        lambda i: match("amount", rng.choice(ops), rng.choice([0.0, 0.1, 2]), i),
        lambda i: match("who", rng.choice(["eq", "neq"]), rng.choice(["A", " b ", "É", "ß"]), i, ignore_case_and_space=rng.random() < 0.7),
        lambda i: match("who", rng.choice(["in", "not_in"]), ["a", "b"], i),
        lambda i: match("who", rng.choice(["eq", "neq"]), None, i),
        lambda i: match("who", "contains", "s", i),
        lambda i: match("small", rng.choice(["in", "not_in"]), [1, 2, -3], i),
        lambda i: rule("column_comparison", i, left_field="amount", operator="gt", right_field="small"),
        lambda i: rule("temporal_sequence", i, event_chain=["day", "seen"]),
        lambda i: match("region", "eq", "north", i),
    ]
    pick = lambda some, k: [make for make in rng.choices(some, k=k)]
    return [
        control("t", [("p", join("people", "who", "name")), *(make() for make in pick(filters, rng.randrange(4)))],
                [make(f"r{k}") for k, make in enumerate(pick(rules, rng.randrange(3)))], control_id=f"C{i:04d}")
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def data(spark):
    people = frame(spark, "name string, region string", [("a", "north"), ("b", "south"), ("ss", None)])
    return catalog(t=frame(spark, SCHEMA, rows()).repartition(3), people=people)


def test_the_index_counts_as_the_aggregates_do(spark, data):
    controls = random_controls(300)
    joined = build_joined(controls[0], data)
    members = members_of(controls, joined, False)
    got = values(indexed_metrics(joined, members, data, False))
    want = [r for k in range(0, 300, 12) for r in values(row_metrics(joined, members[k : k + 12], data, False))]
    assert got == sorted(want) and any(r[3] for r in got)


def test_many_controls_over_an_empty_table(spark, data):
    controls = random_controls(60)
    empty = data.with_frame("t", data.frame("t").filter("id < 0"))
    found = values(report(controls, empty), "verdict", "total_population", "exception_count")
    assert found == [("ERROR", 0, 0)] * 60


def test_a_rule_fails_only_on_rows_it_is_asked_of(spark, data):
    bad = control("t", [("p", join("people", "who", "name")), keep("id", "lt", 0)],
                  [match("who", "eq", 5, ignore_case_and_space=False)], control_id="UNASKED")
    found = values(report([*random_controls(40), bad], data), "control_id", "total_population")
    assert ("UNASKED", 0) in found and len(found) == 41


def test_hundreds_of_controls_read_the_base_once(spark, data, monkeypatch):
    text = plan(report(random_controls(1000), data), "simple")
    assert text.count("MapInArrow") == 1 and text.count("Scan ExistingRDD[id#") <= 1
    monkeypatch.setattr(metrics, "CONTROLS_PER_INDEX", 300)
    monkeypatch.setattr(metrics, "FLAGS_PER_INDEX", 9)
    few = random_controls(700)
    got = values(report(few, data))
    monkeypatch.undo()
    assert got == values(report(few, data))


def test_coverings_keep_every_row_that_a_filter_keeps(spark, data):
    base = data.frame("t")
    lineage = Lineage.of(base, "t")
    rng = random.Random(5)
    for _ in range(12):
        some = [
            (
                FilterComparison("small", rng.choice(["gt", "lt", "eq", "gte", "lte"]), rng.randrange(-4, 5)),
                FilterComparison("seen", rng.choice(["gt", "lt", "eq"]), T0 + timedelta(hours=rng.randrange(100))),
                FilterComparison("who", "eq", rng.choice(["a", "b"])),
                *([FilterComparison("amount", "neq", 0.1)] if rng.random() < 0.5 else []),
            )
            for _ in range(rng.randrange(1, 40))
        ]
        cover = covering(some, lineage)
        kept = {r.id for r in base.filter(cover).collect()}
        controls = [control("t", [keep(f.field, f.operator, f.value) for f in actions]) for actions in some]
        for m in members_of(controls, build_joined(controls[0], data), False):
            assert {r.id for r in base.filter(m.covered).select("id").collect()} <= kept


def test_ranges_and_their_union():
    assert _ranges([Atom("whole", "x", "gt", (3,)), Atom("whole", "x", "lte", (9,)), Atom("whole", "x", "neq", (5,))]) == [(3, 9)]
    assert _ranges([Atom("whole", "x", "in", (7, 1)), Atom("whole", "x", "lt", (4,))]) == [(1, 1)]
    assert _ranges([Atom("whole", "x", "gt", (9,)), Atom("whole", "x", "lt", (4,))]) == []
    assert _ranges([Atom("whole", "x", "not_null")]) is None
    assert _merged([(1, 2), (2, 5), (9, 9), (11, 12), (None, 0), (40, None), (50, 60)], 3) == [(None, 5), (9, 12), (40, None)]
    assert _merged([(None, 4), (3, None)], 3) == [(None, None)]
    assert _merged([], 3) == []


def test_filters_of_a_hundred_controls_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200_000).select("id", (F.col("id") % 97).alias("v")).coalesce(1).sortWithinPartitions("id").write.option("parquet.block.size", 64 << 10).parquet(path)
    data = catalog(t=spark.read.parquet(path))
    some = [control("t", [keep("id", "gte", 150_000 + 10 * i), keep("id", "lt", 150_005 + 10 * i)], [match("v", "lt", 50)], control_id=f"C{i}") for i in range(100)]
    found = report(some, data)
    pushed = re.search(r"PushedFilters: \[(.*?)\]\n", plan(found))[1]
    assert "GreaterThanOrEqual(id,150000)" in pushed and "LessThanOrEqual(id,15" in pushed
    assert {r.total_population for r in found.collect()} == {5}
    read = spark.read.parquet(path).filter("id >= 150000 AND id <= 151000")
    assert read.rdd.getNumPartitions() >= 1 and read.count() == 1001


def test_what_is_no_atom(spark, data):
    lineage = Lineage.of(data.frame("t"), "t")
    for field, op, value in (("cents", "gt", 1), ("rate", "gt", 1), ("who", "gt", "a"), ("flag", "eq", 1), ("amount", "eq", float("nan")), ("small", "eq", 1 << 70)):
        assert atom_of(FilterComparison(field, op, value), lineage) is None
