"""Row rules and filters on literal frames."""

from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from controlweave.functions.conditions import is_exception
from controlweave.plans.metrics import exception_rows
from controlweave.plans.run import attribution, exceptions, population, report
from controlweave.plans.spec import SpecError

from helpers import catalog, computed, control, frame, join, keep, keep_in, keep_null, match, rule, values


def broken(spec, cat, *columns, **options):
    return values(exceptions(spec, cat, **options)["rows"], *columns)


def test_exception_truth_table(spark):
    df = frame(spark, "c boolean", [(True,), (False,), (None,)])
    assert values(df.select("c", is_exception(F.col("c")).alias("x"))) == [
        (None, True), (False, True), (True, False)
    ]


def test_null_is_always_an_exception(spark):
    cat = catalog(t=frame(spark, "k int, v int, s string", [(1, 5, "a"), (2, None, None), (3, 9, "b")]))
    cases = [
        (match("v", "lt", 10), [2]),
        (match("v", "neq", 5), [1, 2]),
        (match("v", "not_in", [9]), [2, 3]),
        (match("v", "in", [5, 9]), [2]),
        (match("s", "eq", "A"), [2, 3]),
        (match("s", "neq", "a"), [1, 2]),
        (match("v", "eq", None), [1, 3]),
        (match("v", "neq", None), [2]),
        (match("s", "contains", "A"), [2, 3]),
        (match("s", "not_contains", "A"), [1, 2]),
    ]
    for rule_, keys in cases:
        assert [k for (k,) in broken(control("t", [], [rule_]), cat, "k")] == keys, rule_


def test_case_and_space_folding(spark):
    cat = catalog(t=frame(spark, "k int, s string", [(1, " active "), (2, "ACTIVE"), (3, "closed")]))
    assert broken(control("t", [], [match("s", "eq", "Active")]), cat, "k") == [(3,)]
    exact = match("s", "eq", "ACTIVE", ignore_case_and_space=False)
    assert broken(control("t", [], [exact]), cat, "k") == [(1,), (3,)]
    assert broken(control("t", [], [match("s", "in", ["ACTIVE"])]), cat, "k") == [(1,), (3,)]


def test_quotes_in_text(spark):
    cat = catalog(t=frame(spark, "k int, s string", [(1, "O'Connor"), (2, 'say "x"')]))
    assert broken(control("t", [], [match("s", "eq", "o'connor")]), cat, "k") == [(2,)]
    spec = control("t", [keep("s", "eq", "O'Connor")])
    assert values(population(spec, cat).frame, "k") == [(1,)]


def test_boolean_expected(spark):
    cat = catalog(t=frame(spark, "k int, b boolean", [(1, True), (2, False), (3, None)]))
    assert broken(control("t", [], [match("b", "eq", True)]), cat, "k") == [(2,), (3,)]
    assert broken(control("t", [], [match("b", "eq", False)]), cat, "k") == [(1,), (3,)]


def test_sequence_is_strict(spark):
    rows = [(1, date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)),
            (2, date(2024, 1, 1), date(2024, 1, 1), date(2024, 1, 3)),
            (3, date(2024, 1, 1), None, date(2024, 1, 3))]
    cat = catalog(t=frame(spark, "k int, a date, b date, c date", rows))
    chain = rule("temporal_sequence", event_chain=["a", "b", "c"])
    assert broken(control("t", [], [chain]), cat, "k") == [(2,), (3,)]


@pytest.mark.parametrize(
    "op, days, keys", [("lte", 14, [3, 4]), ("lt", 14, [2, 3, 4]), ("gte", 14, [1, 4]), ("gt", 14, [1, 2, 4]),
                       ("eq", 14, [1, 3, 4]), ("lte", -1, [1, 2, 3, 4])]
)
def test_date_math(spark, op, days, keys):
    start = datetime(2024, 3, 1, 18, 30)
    rows = [(1, datetime(2024, 3, 10), start), (2, datetime(2024, 3, 15, 23), start),
            (3, datetime(2024, 3, 26), start), (4, None, start)]
    cat = catalog(t=frame(spark, "k int, done timestamp_ntz, begun timestamp_ntz", rows))
    rule_ = rule("temporal_date_math", base_date_field="done", operator=op, target_date_field="begun", offset_days=days)
    assert broken(control("t", [], [rule_]), cat, "k") == [(k,) for k in keys]


def test_date_text_fails_or_is_lenient(spark):
    cat = catalog(t=frame(spark, "k int, a string, b string", [(1, "2024-01-01", "2024-01-02"), (2, "soon", "2024-01-02")]))
    spec = control("t", [], [rule("temporal_date_math", base_date_field="a", operator="lte", target_date_field="b", offset_days=0)])
    with pytest.raises(PySparkException):
        broken(spec, cat, "k")
    assert broken(spec, cat, "k", lenient=True) == [(2,)]


def test_text_against_numbers(spark):
    cat = catalog(t=frame(spark, "k int, s string", [(1, "5"), (2, "5.0"), (3, "x")]))
    with pytest.raises(SpecError, match="order text"):
        broken(control("t", [], [match("s", "gt", 3)]), cat, "k")
    equal = control("t", [], [match("s", "eq", 5)])
    with pytest.raises(PySparkException):
        broken(equal, cat, "k")
    assert broken(equal, cat, "k", lenient=True) == [(3,)]


def test_columns_of_different_kinds(spark):
    cat = catalog(t=frame(spark, "k int, s string, n int, day string, d date", [
        (1, "5.0", 5, "2024-01-01", date(2024, 1, 1)), (2, "6", 5, "2024-01-02", date(2024, 1, 1)),
        (3, "x", 5, "soon", date(2024, 1, 1))]))

    def pair(left, op, right):
        return control("t", [], [rule("column_comparison", left_field=left, operator=op, right_field=right)])

    for left, right in (("s", "n"), ("n", "s"), ("day", "d"), ("d", "day")):
        with pytest.raises(SpecError, match="cannot order"):
            broken(pair(left, "lt", right), cat, "k")
        with pytest.raises(PySparkException):
            broken(pair(left, "eq", right), cat, "k")
        assert broken(pair(left, "eq", right), cat, "k", lenient=True) == [(2,), (3,)]
    with pytest.raises(SpecError, match="cannot order"):
        broken(control("t", [], [rule("temporal_sequence", event_chain=["d", "day"])]), cat, "k")


def test_booleans_compare_as_numbers(spark):
    cat = catalog(t=frame(spark, "k int, b boolean", [(1, True), (2, False)]))
    assert broken(control("t", [], [match("b", "gt", 0)]), cat, "k") == [(2,)]
    assert values(population(control("t", [keep("b", "eq", 1)]), cat).frame, "k") == [(1,)]


def test_timestamp_against_number_is_refused(spark):
    cat = catalog(t=frame(spark, "k int, d date", [(1, date(2024, 1, 1))]))
    with pytest.raises(SpecError, match="number"):
        broken(control("t", [], [match("d", "eq", 5)]), cat, "k")


def test_filters_drop_null_rows(spark):
    cat = catalog(t=frame(spark, "k int, v int, d timestamp_ntz", [
        (1, 5, datetime(2024, 1, 1)), (2, None, datetime(2024, 2, 1)), (3, 9, None)]))
    cases = [
        ([keep("v", "neq", 5)], [3]),
        ([keep("v", "gte", 5), keep("v", "lt", 9)], [1]),
        ([keep_in("v", 5, 7)], [1]),
        ([keep_null("v", True)], [2]),
        ([keep_null("v", False)], [1, 3]),
        ([keep("d", "gt", datetime(2024, 1, 15))], [2]),
        ([keep("d", "gt", "2024-01-15")], [2]),
        ([{"operation": "filter", "filter_expression": "v == 5 OR k = 3"}], [1, 3]),
        ([computed("w", "v * 2"), keep("w", "gt", 10)], [3]),
    ]
    for steps, keys in cases:
        assert values(population(control("t", steps), cat).frame, "k") == [(k,) for k in keys], steps


def test_every_broken_rule_is_named(spark):
    cat = catalog(t=frame(spark, "k int, v int, s string", [(1, 5, "a"), (2, 50, "b"), (3, 50, "a"), (4, 1, "b")]))
    spec = control("t", [], [match("v", "lt", 10, "small"), match("s", "eq", "a", "is_a")])
    found = attribution(spec, cat)
    assert values(found.select("k", F.array_join("failed_assertions", ",").alias("f"))) == [
        (2, "small,is_a"), (3, "small"), (4, "is_a")
    ]


def test_referential_rule_never_multiplies_rows(spark):
    cat = catalog(
        t=frame(spark, "k int, fk int", [(1, 10), (2, 11), (3, None), (4, 10)]),
        ref=frame(spark, "id int", [(10,), (10,), (12,), (None,)]),
    )
    rule_ = rule("referential", "known", foreign_key_field="fk", reference_dataset="ref", reference_key_field="id")
    assert broken(control("t", [], [rule_]), cat, "k") == [(2,), (3,)]
    both = control("t", [], [rule_, match("k", "lt", 4)])
    assert broken(both, cat, "k") == [(2,), (3,), (4,)]


def test_referential_rules_of_a_batch_share_their_lookup(spark):
    cat = catalog(
        t=frame(spark, "k int, fk int, other int", [(1, 10, 5), (2, 11, 5), (3, None, 6)]),
        ref=frame(spark, "id int", [(10,), (12,)]),
        more=frame(spark, "id int", [(5,)]),
    )

    def known(control_id, field, dataset, threshold):
        return control("t", [], [rule("referential", "known", threshold, foreign_key_field=field,
                                      reference_dataset=dataset, reference_key_field="id")], control_id=control_id)

    batch = [known("A", "fk", "ref", 0.0), known("B", "fk", "ref", 80.0), known("C", "other", "more", 0.0)]
    assert values(report(batch, cat), "control_id", "verdict", "exception_count") == [
        ("A", "FAIL", 2), ("B", "PASS", 2), ("C", "FAIL", 1)
    ]
    assert values(exception_rows(batch, cat), "control_id", "k") == [("A", 2), ("A", 3), ("B", 2), ("B", 3), ("C", 3)]


def test_join_miss_fails_rules_on_right_columns(spark):
    cat = catalog(
        t=frame(spark, "k int, who int", [(1, 10), (2, 11)]),
        hr=frame(spark, "id int, status string", [(10, "ACTIVE")]),
    )
    spec = control("t", [("hr", join("hr", "who", "id"))], [match("hr.status", "eq", "ACTIVE")])
    assert broken(spec, cat, "k") == [(2,)]
    absent = control("t", [("hr", join("hr", "who", "id"))], [match("hr_id", "eq", None)])
    assert broken(absent, cat, "k") == [(1,)]
