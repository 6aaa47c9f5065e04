"""Whole runs: verdicts, checks, batches, sinks."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from controlweave.plans import metrics as counting
from controlweave.plans.run import (
    attribution,
    attribution_counts,
    batch_summary,
    dry_run,
    exceptions,
    exceptions_sample,
    report,
    run_control,
    run_controls,
    schema_drift,
)
from controlweave.plans.spec import SpecError
from controlweave.sources.ledger import Ledger

from helpers import catalog, control, frame, join, keep, keep_null, match, plan, rule, values


@pytest.fixture
def trades(spark):
    return frame(spark, "trade_id string, amount bigint, approval_status string, trade_date string", [
        ("T1", 15000, "APPROVED", "2025-01-01"), ("T2", 20000, "PENDING", "2025-01-02"),
        ("T3", 5000, "PENDING", "2025-01-03"), ("T4", 500, "APPROVED", "2025-01-04")])


LARGE_APPROVED = control(
    "trades", [keep("amount", "gt", 10000)], [match("approval_status", "eq", "APPROVED")], control_id="CTRL-TRD"
)


def test_one_exception_of_two_rows(spark, trades):
    row = report([LARGE_APPROVED], catalog(trades=trades)).first()
    assert (row.verdict, row.exception_count, row.total_population, row.exception_rate_percent) == ("FAIL", 1, 2, 50.0)
    assert values(exceptions(LARGE_APPROVED, catalog(trades=trades))["rows"], "trade_id") == [("T2",)]


@pytest.mark.parametrize("threshold, verdict", [(49.99, "FAIL"), (50.0, "PASS"), (50.01, "PASS")])
def test_threshold_is_inclusive(spark, trades, threshold, verdict):
    spec = control("trades", [keep("amount", "gt", 10000)],
                   [match("approval_status", "eq", "APPROVED", threshold=threshold), match("amount", "gt", 0, "r2")])
    row = report([spec], catalog(trades=trades)).first()
    assert (row.verdict, row.materiality_threshold_percent) == (verdict, threshold)


def test_verdict_uses_the_unrounded_rate(spark):
    cat = catalog(t=frame(spark, "k int", [(i,) for i in range(3)]))
    spec = control("t", [], [match("k", "gt", 0, threshold=33.33)])
    row = report([spec], cat).first()
    assert (row.verdict, row.exception_rate_percent) == ("FAIL", 33.33)


def test_zero_population_is_an_error(spark, trades):
    spec = control("trades", [keep("amount", "gt", 10**9)], [match("amount", "gt", 0)])
    row = report([spec], catalog(trades=trades)).first()
    assert (row.verdict, row.exception_count, row.total_population, row.error_type) == ("ERROR", 0, 0, "ZeroPopulation")
    assert row.exception_rate_percent is None and "no rows" in row.error_message


def test_population_counts_follow_joins_and_filters(spark):
    cat = catalog(
        trades=frame(spark, "trade_id int, employee_id string, ticker string", [
            (1, "E1", "A"), (2, "E2", "B"), (3, "E3", "C"), (4, "E4", "D"), (5, "E5", "E")]),
        limits=frame(spark, "employee_id string, ticker string, state string", [("E1", "A", "CLEARED"), ("E2", "B", "OPEN")]),
    )
    wall = ("wall", join("limits", ["employee_id", "ticker"], ["employee_id", "ticker"]))
    state = match("state", "eq", "cleared")
    matched = report([control("trades", [wall, keep_null("wall_employee_id", False)], [state])], cat).first()
    assert (matched.total_population, matched.exception_count) == (2, 1)
    everyone = report([control("trades", [wall], [state])], cat).first()
    assert (everyone.total_population, everyone.exception_count) == (5, 4)


def test_control_without_rules_counts_its_population(spark, trades):
    row = report([control("trades", [])], catalog(trades=trades)).first()
    assert (row.verdict, row.total_population, row.exception_count) == ("PASS", 4, 0)
    listed = exceptions(control("trades", []), catalog(trades=trades), combine="all")["exceptions"]
    assert listed.count() == 4


def test_dry_run_names_the_mistake(spark):
    cat = catalog(t=frame(spark, "status string, amount double", [("APPROVED", 1.0), ("APPROVED", 2.0), ("REJECTED", 3.0)]))
    valid = dry_run(control("t", [], [match("status", "eq", "APPROVED")]), cat)
    assert valid == (True, "Valid")
    for spec, word in [
        (control("t", [], [match("nonexistent", "eq", "x")]), "nonexistent"),
        (control("t", [], [match("status", "lt", 5)]), "order text"),
        (control("t", [{"operation": "filter", "filter_expression": "status =="}]), "PARSE"),
        (control("t", [("j", join("elsewhere", "status", "x"))]), "elsewhere"),
        (control("t", [], [rule("aggregation", "g", group_by_fields=["nope"], metric_field="amount",
                                aggregation_function="SUM", operator="gt", threshold=1)]), "nope"),
        (control("t", [], [rule("aggregation", "g", group_by_fields=["status"], metric_field="status",
                                aggregation_function="AVG", operator="gt", threshold=1)]), "cannot be held"),
        (control("t", sampling={"enabled": True, "sample_size": 3, "sample_key": ["nokey"]}), "nokey"),
    ]:
        ok, message = dry_run(spec, cat)
        assert not ok and word in message


def test_dry_run_starts_no_job(spark):
    cat = catalog(t=frame(spark, "k int", [(1,)]), r=frame(spark, "k int", [(1,)]))
    spec = control("t", [("j", join("r", "k", "k"))], [match("k", "gt", 0)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("dry", "dry")
    assert dry_run(spec, cat)[0]
    assert len(tracker.getJobIdsForGroup("dry")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_schema_drift_is_per_dataset(spark):
    bindings = [
        {"business_term": t, "dataset_alias": a, "technical_field": f, "data_type": d}
        for t, a, f, d in [("s", "a", "status", "string"), ("m", "a", "amount", "numeric"),
                           ("x", "b", "nonexistent_column", "string"), ("d", "c", "day", "date"), ("q", "d", "z", "string")]
    ]
    cat = catalog(
        a=frame(spark, "STATUS string, amount decimal(10,2)", []),
        b=frame(spark, "status string, amount double, date string", []),
        c=frame(spark, "day string", []),
    )
    found = {r.dataset_alias: r for r in schema_drift(spark, control("a", bindings=bindings), cat).collect()}
    assert found["a"].status == "VALID"
    assert found["b"].status == "SCHEMA_DRIFT_DETECTED" and found["b"].missing_columns == ["nonexistent_column"]
    assert found["c"].status == "TYPE_DRIFT_DETECTED" and found["c"].mistyped_columns == ["day"]
    assert found["d"].status == "SCHEMA_DRIFT_DETECTED" and found["d"].available_columns == []


def test_one_bad_control_does_not_stop_the_others(spark, trades):
    cat = catalog(trades=trades)
    text = control("trades", [], [match("approval_status", "eq", 1, ignore_case_and_space=False)], control_id="BAD-DATA")
    unbound = control("trades", [], [match("nope", "eq", "x")], control_id="UNBOUND")
    unfed = control("payroll", [], [match("x", "eq", "x")], control_id="UNFED")
    passing = control("trades", [], [match("amount", "gt", 0)], control_id="OK")
    found = run_controls(spark, [text, LARGE_APPROVED, unbound, unfed, passing], cat).collect()
    assert [(r.control_id, r.verdict) for r in found] == [
        ("BAD-DATA", "ERROR"), ("CTRL-TRD", "FAIL"), ("UNBOUND", "ERROR"), ("UNFED", "SKIPPED"), ("OK", "PASS")
    ]
    by_id = {r.control_id: r for r in found}
    assert "CAST_INVALID_INPUT" in by_id["BAD-DATA"].error_message
    assert by_id["UNBOUND"].error_type == "AnalysisException"
    assert "payroll" in by_id["UNFED"].error_message
    summary = batch_summary(run_controls(spark, [text, LARGE_APPROVED, unfed, passing], cat)).first()
    assert summary.asDict() == {
        "total_projects": 4, "pass_count": 1, "fail_count": 1, "error_count": 1, "skipped_count": 1,
        "cached_dsl_count": 0, "generated_dsl_count": 2,
    }


def test_batch_results_equal_single_results(spark, trades):
    cat = catalog(trades=trades)
    specs = [
        control("trades", [keep("amount", "gt", 100 * i)], [match("amount", "lt", 9000 + 1000 * (i % 9), threshold=float(i))],
                control_id=f"C{i:03d}")
        for i in range(70)
    ]
    together = {r.control_id: r for r in report(specs, cat).collect()}
    assert len(together) == 70
    for spec in specs[::9]:
        assert report([spec], cat).first() == together[spec.control_id]


def test_controls_on_one_population_share_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, "k int, v int, w int", [(i, i % 7, i) for i in range(100)]).write.parquet(path)
    cat = catalog(t=spark.read.parquet(path))
    specs = [control("t", [keep("k", "gt", i)], [match("v", "lt", 5)], control_id=f"C{i}") for i in range(10)]
    text = plan(counting.metrics(specs, cat))
    assert text.count("Scan parquet") == 2  # the operator in the tree and its details
    assert "ReadSchema: struct<k:int,v:int>" in text
    assert "PushedFilters" in text and "GreaterThan(k,0)" in text


def test_exceptions_of_many_controls_come_from_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, "k int, v int, control_id string", [(i, i % 7, "own") for i in range(100)]).write.parquet(path)
    cat = catalog(t=spark.read.parquet(path))
    specs = [control("t", [keep("k", "lt", 20 + i)], [match("v", "lt", i, "a"), match("v", "neq", 3, "b")], control_id=f"C{i}")
             for i in range(8)]
    found = counting.exception_rows(specs, cat)
    assert plan(found, "simple").count("FileScan") == 1
    for i, spec in enumerate(specs):
        mine = found.filter(f"control_id = 'C{i}'").drop("control_id").withColumnRenamed("control_id_1", "control_id")
        alone = attribution(spec, cat)
        assert values(mine, "k", "v", "control_id", "failed_assertions") == values(alone, "k", "v", "control_id", "failed_assertions")


def test_exceptions_per_rule_in_one_pass(spark, trades):
    spec = control("trades", [], [match("amount", "gt", 1000, "big"), match("approval_status", "eq", "approved", "ok")])
    assert values(attribution_counts(spec, catalog(trades=trades))) == [("big", 1), ("ok", 2)]


def test_sample_of_exceptions_is_ordered_and_limited(spark):
    df = frame(spark, "k int, d timestamp_ntz", [(i, datetime(2024, 1, 1)) for i in reversed(range(300))])
    rows = [json.loads(r.exception_json) for r in exceptions_sample(df).collect()]
    assert [r["k"] for r in rows] == list(range(100))
    assert rows[0]["d"].startswith("2024-01-01T00:00:00")


def test_sample_json_keeps_nulls_and_has_no_nan(spark):
    df = frame(spark, "k int, x double, s string", [(1, float("nan"), None), (2, 1.5, "a")])
    rows = [json.loads(r.exception_json) for r in exceptions_sample(df, ["k"]).collect()]
    assert rows == [{"k": 1, "x": None, "s": None}, {"k": 2, "x": 1.5, "s": "a"}]


def test_a_batch_survives_bad_files_maps_and_bad_casts(spark, trades, tmp_path):
    bad = str(tmp_path / "bad")
    trades.coalesce(1).write.parquet(bad)
    unreadable = spark.read.schema(trades.schema).parquet(bad)
    part = next(f for f in os.listdir(bad) if f.startswith("part-"))
    (tmp_path / "bad" / part).write_bytes(b"PAR1 no more PAR1")
    for name in os.listdir(bad):
        if name.endswith(".crc"):
            os.remove(os.path.join(bad, name))
    maps = frame(spark, "k int, m map<string,string>", [(1, {"a": "b"}), (2, None)])
    cat = catalog(trades=trades, unreadable=unreadable, maps=maps)
    controls = [
        LARGE_APPROVED,
        control("unreadable", [], [match("amount", "gt", 0)], control_id="FILE"),
        control("maps", [], [match("k", "gt", 1)], control_id="MAP"),
    ]
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    found = {r.control_id: r for r in run_controls(spark, controls, cat, ledger).collect()}
    assert {i: r.verdict for i, r in found.items()} == {"CTRL-TRD": "FAIL", "FILE": "ERROR", "MAP": "FAIL"}
    stored = {r.control_id: r for r in ledger.executions().collect()}
    sampled = json.loads(stored["MAP"].exceptions_sample)
    assert set(stored) == set(found) and [(r["k"], r["m"]) for r in sampled] == [(1, {"a": "b"})]


def test_ids_used_twice_are_refused(spark, trades):
    with pytest.raises(SpecError, match="CTRL-TRD"):
        run_controls(spark, [LARGE_APPROVED, LARGE_APPROVED], catalog(trades=trades))


def test_an_unseeded_sample_is_one_sample_for_report_and_exceptions(spark, tmp_path):
    cat = catalog(t=frame(spark, "k int", [(i,) for i in range(400)]))
    plan = {"enabled": True, "method": "random", "sample_size": 100, "random_seed": None}
    spec = control("t", [], [match("k", "lt", 200)], plan, control_id="S")
    ledger, out = Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "out")
    row = run_controls(spark, [spec], cat, ledger, out).first()
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/t-sample-S")
    assert stored.count() == row.exception_count
    assert json.loads(ledger.executions().first().control_json)["population"]["sampling"]["random_seed"]


def test_one_control_alone(spark, trades):
    verdicts, found = run_control(LARGE_APPROVED, catalog(trades=trades))
    assert verdicts.first().verdict == "FAIL" and found["rows"].count() == 1


def test_exceptions_and_executions_are_stored(spark, trades, tmp_path):
    limit = rule("aggregation", "per_status", group_by_fields=["approval_status"], metric_field="amount",
                 aggregation_function="SUM", operator="lte", threshold=20000)
    grouped = control("trades", [], [limit, match("amount", "gt", 1000, "big")], control_id="GROUPED")
    cat = catalog(trades=trades)
    cat.add("trades", trades, sha256_hash="abc")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    when = datetime(2025, 3, 1, 12)
    out = str(tmp_path / "exceptions")
    ledger.append_controls([LARGE_APPROVED, grouped], "auditor", when)
    run_controls(spark, [LARGE_APPROVED, grouped], cat, ledger, out, executed_at=when)
    tables = {name.rsplit("-", 1)[0] if "rows" in name else name: f"{out}/{name}" for name in os.listdir(out)}
    assert sorted(tables) == ["trades-groups-GROUPED-per_status", "trades-rows"]
    rows = spark.read.parquet(tables["trades-rows"])
    assert values(rows, "control_id", "trade_id") == [("CTRL-TRD", "T2"), ("GROUPED", "T4")]
    groups = spark.read.parquet(tables["trades-groups-GROUPED-per_status"])
    assert values(groups, "control_id", "approval_status", "total_amount") == [("GROUPED", "PENDING", 25000)]
    stored = {r.control_id: r for r in ledger.executions().collect()}
    assert stored["CTRL-TRD"].evidence_hashes == {"trades": "abc"}
    assert stored["CTRL-TRD"].executed_at == when
    assert json.loads(stored["CTRL-TRD"].exceptions_sample)[0]["trade_id"] == "T2"
    assert len(json.loads(stored["GROUPED"].exceptions_sample)) == 2
    assert ledger.current_control("GROUPED") == grouped
    assert ledger.current_control("NONE") is None


def test_a_sample_that_cannot_be_stored_is_told(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from controlweave.plans import run as module

    real = module.joined_samples

    def failing(session, parts, *more):
        found = real(session, parts, *more)
        return found.withColumn("exceptions_sample", F.raise_error(F.lit("no space"))) if parts else found

    monkeypatch.setattr(module, "joined_samples", failing)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    cat = catalog(t=frame(spark, "k int", [(1,), (2,)]))
    specs = [control("t", [], [match("k", "eq", 1)], control_id="BAD"), control("t", [], [match("k", "gt", 0)], control_id="GOOD")]
    found = {r.control_id: r for r in run_controls(spark, specs, cat, ledger=ledger).collect()}
    assert found["BAD"].verdict == "FAIL" and found["BAD"].error_type == "SampleNotStored" and "no space" in found["BAD"].error_message
    assert found["GOOD"].verdict == "PASS" and found["GOOD"].error_message is None
    assert values(ledger.executions(), "control_id", "verdict", "error_type") == [("BAD", "FAIL", "SampleNotStored"), ("GOOD", "PASS", None)]


def test_samples_rank_hashes_before_any_json_is_sorted(spark):
    from controlweave.plans.run import samples_per_control

    rows = spark.range(20_000).select(F.concat(F.lit("C"), F.col("id") % 3).alias("control_id"), (F.col("id") % 7000).alias("v"))
    found = samples_per_control(rows, 20)
    lines = rows.select("control_id", F.to_json(F.struct("v")).alias("j")).withColumn("h", F.xxhash64("j")).collect()
    wanted = {(c, k + 1, j) for c in ("C0", "C1", "C2") for k, (_, j) in enumerate(sorted((r.h, r.j) for r in lines if r.control_id == c)[:20])}
    assert {tuple(r) for r in found.collect()} == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # what is ranked with its JSON has passed the join with the controls' largest ranked hashes
    assert "Join" in plan and plan.rindex("exception_json") > plan.index("Join")
