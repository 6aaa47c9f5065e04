"""Group rules."""

import pytest

from controlweave.plans.metrics import metrics
from controlweave.plans.run import exceptions, report
from controlweave.plans.spec import SpecError

from helpers import catalog, control, frame, keep, match, rule, values

ROWS = [("a", 10.0, "x"), ("a", 20.0, "y"), ("b", 5.0, "x"), ("b", None, "x"), ("c", None, "z"), (None, 100.0, "x")]


def limit(function, operator, threshold, rule_id="g", keys=("k",), field="v", **more):
    return rule("aggregation", rule_id, group_by_fields=list(keys), metric_field=field,
                aggregation_function=function, operator=operator, threshold=threshold, **more)


@pytest.fixture
def cat(spark):
    return catalog(t=frame(spark, "k string, v double, s string", ROWS))


@pytest.mark.parametrize(
    "function, operator, threshold, failing",
    [
        ("SUM", "lte", 25, [None, "a", "c"]),
        ("COUNT", "gte", 1, ["c"]),
        ("COUNT", "eq", 2, [None, "b", "c"]),
        ("AVG", "lt", 15, [None, "a", "c"]),
        ("MIN", "gt", 5, ["b", "c"]),
        ("MAX", "gte", 20, ["b", "c"]),
    ],
)
def test_limits(cat, function, operator, threshold, failing):
    found = exceptions(control("t", [], [limit(function, operator, threshold)]), cat)["g"]
    assert [k for (k,) in values(found, "k")] == failing


def test_group_columns(cat):
    found = exceptions(control("t", [], [limit("SUM", "lte", 25)]), cat)["g"]
    assert values(found) == [(None, 1, 100.0, 100.0), ("a", 2, 30.0, 30.0), ("c", 1, None, None)]


def test_count_of_text_has_no_total(cat):
    found = exceptions(control("t", [], [limit("COUNT", "lt", 2, field="s")]), cat)["g"]
    assert values(found) == [("a", 2, 2, None), ("b", 2, 2, None)]


def test_booleans_are_counted(spark):
    cat = catalog(t=frame(spark, "k string, b boolean", [("a", True), ("a", True), ("b", True), ("b", False), ("c", None)]))
    found = exceptions(control("t", [], [limit("SUM", "lte", 1, field="b")]), cat)["g"]
    assert values(found) == [("a", 2, 2, 2), ("c", 1, None, None)]
    worst = exceptions(control("t", [], [limit("MIN", "gte", 1, field="b")]), cat)["g"]
    assert values(worst, "k") == [("b",), ("c",)]


def test_sum_of_text_is_refused(cat):
    with pytest.raises(SpecError, match="cannot be held"):
        exceptions(control("t", [], [limit("SUM", "lt", 2, field="s")]), cat)


def test_all_rules_must_fail_when_combined(cat):
    spec = control("t", [], [limit("SUM", "lte", 25, "g1"), limit("COUNT", "lte", 1, "g2")])
    assert values(exceptions(spec, cat, combine="all")["exceptions"]) == [("a", 2, 30.0)]
    each = exceptions(spec, cat)
    assert [k for (k,) in values(each["g1"], "k")] == [None, "a", "c"]
    assert [k for (k,) in values(each["g2"], "k")] == ["a"]


def test_row_rules_filter_first_when_combined(cat):
    spec = control("t", [], [match("s", "neq", "x", "not_x"), limit("SUM", "lte", 4, "g1")])
    # the rows that break not_x are those with s = x: one of a, two of b, one without key
    found = values(exceptions(spec, cat, combine="all")["exceptions"])
    assert found == [(None, 1, 100.0), ("a", 1, 10.0), ("b", 2, 5.0)]


def test_counts_per_control_share_a_grouping(cat):
    one = control("t", [keep("s", "eq", "x")], [limit("SUM", "lte", 25)], control_id="one")
    two = control("t", [], [limit("COUNT", "gte", 2)], control_id="two")
    both = control("t", [], [match("v", "neq", None, "r"), limit("SUM", "lte", 25)], control_id="both")
    found = {r["control_id"]: r for r in metrics([one, two, both], cat).collect()}
    picked = lambda c: tuple(found[c][m] for m in ("total_population", "row_exceptions", "failing_groups", "group_population"))
    assert picked("one") == (4, 0, 1, 3)  # rows with s = x: of a, b twice, and without key
    assert picked("two") == (6, 0, 3, 4)
    assert picked("both") == (6, 2, 3, 4)


def test_rates_of_groups_and_rows(cat):
    spec = control("t", [], [limit("SUM", "lte", 25, materiality=50.0)])
    row = report([spec], cat).first()
    assert (row.verdict, row.exception_count, row.total_population) == ("PASS", 3, 6)
    assert (row.exception_rate_percent, row.group_population, row.group_exception_rate_percent) == (50.0, 4, 75.0)


def test_several_group_rules_add_up(cat):
    spec = control("t", [], [limit("SUM", "lte", 25, "g1"), limit("COUNT", "lte", 0, "g2", keys=("s",))])
    row = report([spec], cat).first()
    assert (row.exception_count, row.group_population) == (3 + 2, 4 + 3)


def test_group_rules_on_an_empty_population(cat):
    spec = control("t", [keep("v", "gt", 1000)], [limit("SUM", "lte", 25)])
    row = report([spec], cat).first()
    assert (row.verdict, row.total_population, row.group_population) == ("ERROR", 0, 0)
