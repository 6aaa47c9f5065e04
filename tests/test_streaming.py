"""Continuous controls on small file streams."""

import pytest
from datetime import datetime, timedelta

from controlweave.sources.catalog import Catalog
from controlweave.plans.spec import SpecError
from controlweave.sources.ledger import Ledger
from controlweave.streaming.continuous import (
    GroupStates,
    file_stream,
    missed_follow_ups,
    start_group_verdicts,
    row_exception_stream,
    start_sink,
    start_verdicts,
    windowed_failing_groups,
)

from helpers import control, frame, join, keep, match, rule, values

T0 = datetime(2025, 1, 1)
SCHEMA = "event_id int, ts timestamp_ntz, who int, amount double"


def write(spark, path, rows):
    frame(spark, SCHEMA, rows).coalesce(1).write.mode("append").parquet(path)


def drain(stream, tmp_path, name="out"):
    start_sink(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


def test_row_exceptions_arrive_once_per_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [(1, T0, 1, 5.0), (2, T0, 2, 50.0), (3, T0, 9, 5.0)])
    people = frame(spark, "id int, status string", [(1, "ACTIVE"), (2, "ACTIVE"), (3, "LEFT")])
    spec = control("events", [keep("amount", "gt", 1), ("p", join("people", "who", "id"))],
                   [match("amount", "lt", 10, "small"), match("status", "eq", "active", "known")])

    def catalog():
        return Catalog({"people": people}).add("events", file_stream(spark, path))

    found = drain(row_exception_stream(spec, catalog()), tmp_path)
    assert values(found, "event_id") == [(2,), (3,)]
    write(spark, path, [(4, T0, 3, 5.0), (5, T0, 1, 6.0)])
    found = drain(row_exception_stream(spec, catalog()), tmp_path)
    assert values(found, "event_id", "status") == [(2, "ACTIVE"), (3, None), (4, "LEFT")]


def test_windows_are_judged_when_closed_and_late_rows_are_left_out(spark, tmp_path):
    path = str(tmp_path / "in")
    limit = rule("aggregation", "g", group_by_fields=["who"], metric_field="amount",
                 aggregation_function="SUM", operator="lte", threshold=10)
    spec = control("events", [], [limit])

    def stream():
        cat = Catalog().add("events", file_stream(spark, path))
        return windowed_failing_groups(spec, spec.group_assertions[0], cat, "ts", "1 hour", "30 minutes")

    minutes = lambda m: T0 + timedelta(minutes=m)
    write(spark, path, [(1, minutes(5), 1, 8.0), (2, minutes(50), 1, 8.0), (3, minutes(20), 2, 9.0), (4, minutes(70), 2, 99.0)])
    assert drain(stream(), tmp_path).count() == 0  # the watermark is at 0:40, no window is closed
    write(spark, path, [(5, minutes(55), 2, 2.0), (6, minutes(200), 3, 1.0)])
    found = drain(stream(), tmp_path)
    closed = [(T0, 1, 2, 16.0), (T0, 2, 2, 11.0), (minutes(60), 2, 1, 99.0)]
    assert values(found, "window_start", "who", "exception_count", "metric_value") == closed
    write(spark, path, [(7, minutes(10), 3, 500.0), (8, minutes(400), 3, 1.0)])
    found = drain(stream(), tmp_path)
    assert values(found, "window_start", "who", "exception_count", "metric_value") == closed


def test_each_micro_batch_gets_a_verdict(spark, tmp_path):
    path = str(tmp_path / "in")
    spec = control("events", [], [match("amount", "lt", 10)], control_id="LIVE")
    ledger = Ledger(spark, str(tmp_path / "ledger"))

    def run():
        cat = Catalog().add("events", file_stream(spark, path))
        start_verdicts(spec, cat, ledger, str(tmp_path / "state")).awaitTermination()

    write(spark, path, [(1, T0, 1, 5.0), (2, T0, 1, 50.0)])
    run()
    write(spark, path, [(3, T0, 1, 5.0)])
    run()
    assert values(ledger.executions(), "verdict", "exception_count", "total_population") == [("FAIL", 1, 2), ("PASS", 0, 1)]


def test_a_replayed_micro_batch_is_recorded_once_and_group_rules_are_refused(spark, tmp_path):
    path = str(tmp_path / "in")
    spec = control("events", [], [match("amount", "lt", 10)], control_id="LIVE")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    write(spark, path, [(1, T0, 1, 5.0), (2, T0, 1, 50.0)])
    state = tmp_path / "state"
    for _ in range(2):
        start_verdicts(spec, Catalog().add("events", file_stream(spark, path)), ledger, str(state)).awaitTermination()
        for done in (state / "commits").glob("*0*"):  # as if the run had ended before it was noted as done
            done.unlink()
    assert values(ledger.executions(), "verdict", "exception_count") == [("FAIL", 1)]
    limit = rule("aggregation", "g", group_by_fields=["who"], metric_field="amount", aggregation_function="SUM", operator="lte", threshold=10)
    with pytest.raises(SpecError, match="windowed_failing_groups"):
        start_verdicts(control("events", [], [limit]), Catalog().add("events", file_stream(spark, path)), ledger, str(tmp_path / "s2"))


def group_limit(keys, function="SUM", operator="lte", threshold=10, name="g"):
    return rule("aggregation", name, group_by_fields=keys, metric_field="amount",
                aggregation_function=function, operator=operator, threshold=threshold)


def test_group_verdicts_follow_the_groups_across_micro_batches_and_replays(spark, tmp_path):
    path = str(tmp_path / "in")
    spec = control("events", [keep("event_id", "gt", 0)], [group_limit(["who"]), match("amount", "lt", 100, "small")], control_id="LIVE")
    ledger, states, checkpoint = Ledger(spark, str(tmp_path / "ledger")), GroupStates(spark, str(tmp_path / "groups"), compact_every=2), tmp_path / "state"

    def run():
        start_group_verdicts(spec, Catalog().add("events", file_stream(spark, path)), ledger, states, str(checkpoint)).awaitTermination()

    recorded = lambda: values(ledger.executions(), "total_population", "exception_count", "verdict")
    arriving = [
        [(1, T0, 1, 6.0), (2, T0, 2, 6.0), (3, T0, None, 1.0)],
        [(4, T0, 1, 6.0), (5, T0, 3, 500.0)],  # group 1 breaks its limit, 3 the limit and the row rule
        [(6, T0, 1, -9.0), (7, T0, 2, None)],  # group 1 is within it again, an absent amount breaks the row rule
        [(8, T0, None, 50.0), (0, T0, 9, 999.0)],
    ]
    want = [(3, 0, "PASS"), (5, 3, "FAIL"), (7, 3, "FAIL"), (8, 4, "FAIL")]
    for k, rows in enumerate(arriving):
        write(spark, path, rows)
        run()
        assert recorded() == want[: k + 1]
        for done in (checkpoint / "commits").glob(f"*{k}*"):  # as if the run had ended before it was noted as done
            done.unlink()
        run()
        assert recorded() == want[: k + 1]
    assert values(states.current(3), "key_who", "rows", "metric_0", "failing") == [
        (None, 2, 51.0, [True]), (1, 3, 3.0, [False]), (2, 2, 6.0, [False]), (3, 1, 500.0, [True])
    ]


def test_group_verdicts_need_group_rules_of_one_grain(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [(1, T0, 1, 5.0)])
    ledger, states = Ledger(spark, str(tmp_path / "ledger")), GroupStates(spark, str(tmp_path / "groups"))
    for rules in ([match("amount", "lt", 10)], [group_limit(["who"]), group_limit(["event_id"], name="h")]):
        with pytest.raises(SpecError):
            start_group_verdicts(control("events", [], rules), Catalog().add("events", file_stream(spark, path)), ledger, states, str(tmp_path / "s"))


def test_follow_ups_are_awaited_until_their_deadline(spark, tmp_path):
    opened, closed = str(tmp_path / "opened"), str(tmp_path / "closed")
    spec = control("opened", [keep("amount", "gt", 0), ("c", join("closed", "who", "who"))])
    day = lambda n: T0 + timedelta(days=n)

    def found():
        cat = Catalog().add("opened", file_stream(spark, opened)).add("closed", file_stream(spark, closed))
        return values(drain(missed_follow_ups(spec, cat, "ts", "ts", "1 DAY", "2 hours"), tmp_path), "event_id")

    write(spark, opened, [(1, day(0), 1, 1.0), (2, day(0), 2, 1.0), (3, day(0), 3, 1.0), (4, day(0), None, 1.0), (5, day(0), 5, -1.0), (6, None, 6, 1.0)])
    write(spark, closed, [(11, day(0.5), 1, 0.0), (12, day(1.5), 2, 0.0), (13, None, 3, 0.0)])
    assert found() == []  # nothing is certain yet
    write(spark, closed, [(14, day(0.9), 3, 0.0), (15, day(4), 9, 0.0)])  # 3 is closed late in arrival, but in time
    assert found() == []  # the other stream is still at day 0
    write(spark, opened, [(7, day(3), 7, 1.0)])
    write(spark, closed, [(17, day(4), 9, 0.0)])  # a stream that is silent since a restart holds the watermark back
    assert found() == [(2,), (4,)]
    write(spark, opened, [(8, day(9), 8, 1.0)])
    write(spark, closed, [(16, day(9), 8, 0.0)])
    assert found() == [(2,), (4,), (7,)]


def test_deadlines_take_one_join_and_filters(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [(1, T0, 1, 5.0)])
    cat = Catalog().add("events", file_stream(spark, path))
    with pytest.raises(SpecError, match="one left join"):
        missed_follow_ups(control("events", [keep("amount", "gt", 0)]), cat, "ts", "ts", "1 DAY", "1 hour")
