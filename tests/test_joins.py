"""Joins: names, fan-out, latest rows and hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from controlweave.operators.joins import equi_join, latest_per_key
from controlweave.plans.run import population
from controlweave.plans.spec import SpecError
from controlweave.sources.catalog import Catalog

from helpers import catalog, control, frame, join, keep, keep_null, plan, values


def test_names_after_a_join(spark):
    cat = catalog(
        left=frame(spark, "id int, status string, note string", [(1, "L", "x")]),
        right=frame(spark, "id int, status string, extra int", [(1, "R", 7)]),
    )
    joined = population(control("left", [("j", join("right", "id", "id"))]), cat)
    assert joined.frame.columns == ["id", "status", "note", "status_1", "extra", "j_id"]
    names = joined.lineage
    assert names.physical("status") == "status"
    assert names.physical("right.status") == "status_1"
    assert names.physical("j.status") == "status_1"
    assert names.physical("left.status") == "status"
    assert names.physical("RIGHT.Extra") == "extra"
    assert names.physical("right.id") == "j_id"
    assert names.physical("elsewhere.note") == "note"


def test_one_key_name_joined_twice(spark):
    cat = catalog(
        hr=frame(spark, "emp int", [(1,), (2,)]),
        tickets=frame(spark, "emp int, state string", [(1, "CLOSED")]),
        accounts=frame(spark, "emp int, state string", [(2, "OPEN")]),
    )
    spec = control("hr", [("t", join("tickets", "emp", "emp")), ("a", join("accounts", "emp", "emp"))])
    df = population(spec, cat).frame
    assert df.columns == ["emp", "state", "t_emp", "state_1", "a_emp"]
    assert values(df) == [(1, "CLOSED", 1, None, None), (2, None, None, "OPEN", 2)]


def test_composite_keys_and_match_filter(spark):
    cat = catalog(
        trades=frame(spark, "trade_id int, employee_id string, ticker string", [
            (1, "E1", "AAPL"), (2, "E1", "MSFT"), (3, "E2", "AAPL"), (4, "E3", "TSLA"), (5, None, "AAPL")]),
        restrictions=frame(spark, "employee_id string, ticker string, status string", [
            ("E1", "AAPL", "RESTRICTED"), ("E3", "TSLA", "CLEARED")]),
    )
    steps = [
        ("wall", join("restrictions", ["employee_id", "ticker"], ["employee_id", "ticker"])),
        keep_null("wall_employee_id", False),
    ]
    assert values(population(control("trades", steps), cat).frame, "trade_id") == [(1,), (4,)]


def test_key_alias_collision_is_refused(spark):
    cat = catalog(left=frame(spark, "id int, j_id int", [(1, 1)]), right=frame(spark, "id int", [(1,)]))
    with pytest.raises(SpecError, match="exists already"):
        population(control("left", [("j", join("right", "id", "id"))]), cat)


def test_fan_out_is_kept(spark):
    cat = catalog(l=frame(spark, "k int", [(1,), (2,)]), r=frame(spark, "k int, v int", [(1, 1), (1, 1), (1, 2)]))
    df = population(control("l", [("j", join("r", "k", "k"))]), cat).frame
    assert values(df, "k", "v") == [(1, 1), (1, 1), (1, 2), (2, None)]


def test_latest_row_joined(spark):
    cat = catalog(
        vendors=frame(spark, "v int", [(1,), (2,), (3,)]),
        reviews=frame(spark, "v int, day int, state string", [
            (1, 1, "PASSED"), (1, 9, "FAILED"), (2, 3, "PASSED"), (2, None, "OLD")]),
    )
    spec = control("vendors", [("r", join("reviews", "v", "v", latest_by=["day"]))])
    assert values(population(spec, cat).frame, "v", "state") == [(1, "FAILED"), (2, "PASSED"), (3, None)]


def test_latest_per_key(spark):
    df = frame(spark, "k int, t int, id int", [(1, 5, 1), (1, 5, 2), (1, 4, 9), (None, 1, 3)])
    assert values(latest_per_key(df, ["k"], ["t", "id"])) == [(None, 1, 3), (1, 5, 2)]


def hot_sides(spark):
    """A third of the right rows share one key, most of them exact copies."""
    rng = random.Random(7)
    right = [(1, "copy")] * 1500 + [(1, f"r{i}") for i in range(500)]
    right += [(rng.randrange(2, 300), f"x{i}") for i in range(3800)] + [(None, "n")] * 200
    left = [(1, i) for i in range(3)] + [(rng.randrange(2, 400), i) for i in range(2000)] + [(None, -1), (999, -2)]
    l = frame(spark, "lk int, lv int", left).repartition(5)
    r = frame(spark, "rk int, rv string", right).repartition(16)
    return l, r


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_salted_join_equals_the_plain_one(spark, how):
    l, r = hot_sides(spark)
    split = equi_join(l, r, [("lk", "rk")], how, rows_per_key=10**9, split_above=100)
    assert split.columns == ["lk", "lv", "rk", "rv"]
    assert values(split) == values(l.join(r, l.lk == r.rk, how))


def test_a_task_that_runs_again_salts_as_before(spark):
    """Shares follow from values, not from the order in which rows arrive."""
    from pyspark.sql import functions as F

    l, r = hot_sides(spark)
    text = plan(equi_join(l, r, [("lk", "rk")], "left", rows_per_key=10**9, split_above=100), "simple")
    assert "rand(" not in text and "monotonically" not in text
    want = values(l.join(r, l.lk == r.rk, "left"))
    for n in (1, 3, 7):  # other tasks, other orders
        shuffled = r.orderBy(F.xxhash64("rv", F.lit(n))).repartition(n)
        assert values(equi_join(l, shuffled, [("lk", "rk")], "left", rows_per_key=10**9, split_above=100)) == want


def test_a_hot_right_key_is_spread(spark):
    """No partition of the salted join holds more than about one share of the hot key."""
    before = {n: spark.conf.get(n) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        l, r = hot_sides(spark)
        l = l.dropDuplicates(["lk"])
        most = lambda df: max(row["count"] for row in df.groupBy(F.spark_partition_id()).count().collect())
        split = equi_join(l, r, [("lk", "rk")], "left", rows_per_key=10**9, split_above=100)
        assert most(split) < 0.6 * most(l.join(r, l.lk == r.rk, "left"))
        assert values(split) == values(l.join(r, l.lk == r.rk, "left"))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_only_keys_that_may_be_hot_are_measured(spark):
    l, r = frame(spark, "k int", [(1,)]), frame(spark, "k int, v int", [(1, 1)])
    spec = control("l", [("j", join("r", "k", "k"))])
    cases = [
        (Catalog({"l": l}).add("r", r, rows=10**9), True),
        (Catalog({"l": l}).add("r", r, rows=10**6), False),
        (Catalog({"l": l}).add("r", r, rows=10**9, unique=("k",)), False),
        (Catalog({"l": l}).add("r", r), False),
    ]
    for cat, measured in cases:
        assert ("_shares" in plan(population(spec, cat).frame, "simple")) == measured


def test_chained_joins_scan_each_side_once(spark, tmp_path):
    paths = []
    for name in "abcdef":
        frame(spark, "k int, v int", [(i, i) for i in range(20)]).write.parquet(str(tmp_path / name))
        paths.append(spark.read.parquet(str(tmp_path / name)))
    cat = catalog(**dict(zip("abcdef", paths)))
    steps = [(f"j{n}", join(n, "k", "k")) for n in "bcdef"]
    assert plan(population(control("a", steps), cat).frame, "simple").count("FileScan parquet") == 6


def test_filters_may_precede_the_join_they_need(spark):
    cat = catalog(
        t=frame(spark, "k int", [(1,), (2,)]), r=frame(spark, "k int, v int", [(1, 5), (2, 50)])
    )
    spec = control("t", [keep("v", "gt", 10), ("j", join("r", "k", "k"))])
    assert values(population(spec, cat).frame, "k") == [(2,)]
