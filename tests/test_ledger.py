"""Ledger analytics on small histories."""

from datetime import datetime, timedelta

from controlweave.sources.ledger import (
    Ledger,
    current_controls,
    dashboard_stats,
    evidence_lineage,
    execution_history,
)

from controlweave.plans.run import run_controls

from helpers import catalog, control, frame, match, values

T0 = datetime(2025, 1, 31, 12)
EXECUTIONS = (
    "execution_id string, control_id string, verdict string, exception_count bigint, total_population bigint, "
    "exception_rate_percent double, executed_at timestamp_ntz, evidence_hashes map<string,string>"
)


def run(i, control_id="C1", verdict="PASS", rate=1.0, days=0, hashes=None):
    return (f"E{i}", control_id, verdict, 1, 100, rate, T0 - timedelta(days=days), hashes or {})


def test_history_is_newest_first_and_limited(spark):
    df = frame(spark, EXECUTIONS, [run(i, days=i) for i in range(20)] + [run(99, "C2")])
    found = execution_history(df, "C1", limit=5).collect()
    assert [r.execution_id for r in found] == ["E0", "E1", "E2", "E3", "E4"]
    assert "evidence_hashes" not in found[0].asDict()


def test_dashboard_covers_thirty_days_and_leaves_errors_out_of_the_mean(spark):
    df = frame(spark, EXECUTIONS, [
        run(1, verdict="PASS", rate=1.0), run(2, verdict="FAIL", rate=4.0, days=30),
        run(3, verdict="ERROR", rate=None, days=2), run(4, verdict="FAIL", rate=50.0, days=31)])
    controls = frame(spark, "control_id string", [("C1",), ("C1",), ("C2",)])
    assert dashboard_stats(df, controls, T0).first().asDict() == {
        "total_controls": 2, "pass_count": 1, "fail_count": 1, "error_count": 1, "avg_exception_rate": 2.5
    }
    empty = dashboard_stats(df.filter("false"), controls, T0).first()
    assert (empty.pass_count, empty.avg_exception_rate) == (0, 0.0)


def manifests(spark, rows):
    return frame(spark, "dataset_alias string, sha256_hash string, ingested_at timestamp_ntz",
                 [(a, h, T0 + timedelta(hours=i)) for i, (a, h) in enumerate(rows)])


def test_lineage_tells_tampering(spark):
    df = frame(spark, EXECUTIONS, [
        run(1, hashes={"a": "h1", "b": "x"}), run(2, hashes={"a": "h2", "c": "z"}), run(3, hashes={"d": None})])
    landed = manifests(spark, [("a", "h1"), ("a", "h2"), ("b", "y"), ("d", "q")])
    columns = ("execution_id", "dataset_alias", "stored_hash", "integrity_status")
    everything = values(evidence_lineage(df, landed), *columns)
    assert everything == [
        ("E1", "a", "h1", "VALID"), ("E1", "a", "h2", "TAMPERED"), ("E1", "b", "y", "TAMPERED"),
        ("E2", "a", "h1", "TAMPERED"), ("E2", "a", "h2", "VALID"),
    ]
    assert values(evidence_lineage(df, landed, execution_id="E2"), *columns) == everything[3:]
    assert values(evidence_lineage(df, landed, latest_only=True), *columns) == [
        ("E1", "a", "h2", "TAMPERED"), ("E1", "b", "y", "TAMPERED"), ("E2", "a", "h2", "VALID")
    ]


def test_lineage_limit_equals_the_head_of_all_pairs(spark):
    """Narrowing the runs before the join must not change the listed lines."""
    df = frame(spark, EXECUTIONS, [
        run(i, days=i % 11, hashes={"a": f"h{i % 3}", "zz" if i % 2 else "b": "q"}) for i in range(60)])
    landed = manifests(spark, [("a", f"h{i % 4}") for i in range(9)] + [("b", "q")] * 3)
    got = [tuple(r) for r in evidence_lineage(df, landed, limit=37).collect()]
    pairs = []
    for r in df.collect():
        for m in landed.collect():
            if m.dataset_alias in r.evidence_hashes:
                mine = r.evidence_hashes[m.dataset_alias]
                status = "VALID" if mine == m.sha256_hash else "TAMPERED"
                key = (-r.executed_at.timestamp(), r.execution_id, m.dataset_alias, m.ingested_at, m.sha256_hash)
                pairs.append((key, (r.execution_id, r.control_id, r.verdict, r.executed_at, m.dataset_alias,
                                    m.sha256_hash, mine, status)))
    assert sorted(got, key=str) == sorted([p for _, p in sorted(pairs)][:37], key=str)


def test_every_version_is_kept_and_the_newest_is_current(spark):
    df = frame(spark, "control_id string, version string, approved_at timestamp_ntz", [
        ("C1", "1", T0), ("C1", "2", T0 + timedelta(1)), ("C2", "1", T0), ("C1", "3", T0 - timedelta(1))])
    assert values(current_controls(df), "control_id", "version") == [("C1", "2"), ("C2", "1")]


def test_an_empty_ledger_has_its_columns(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "none"))
    assert ledger.executions().count() == ledger.controls().count() == ledger.manifests().count() == 0
    assert "evidence_hashes" in ledger.executions().columns


def test_runs_are_stored_by_day_and_compacted(spark, tmp_path):
    from datetime import date

    cat = catalog(t=frame(spark, "k int", [(1,), (2,)]))
    specs = [control("t", [], [match("k", "gt", i)], control_id=f"C{i:02d}") for i in range(40)]
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    for day in (1, 1, 1, 2):
        run_controls(spark, specs, cat, ledger=ledger, executed_at=datetime(2025, 1, day, 12))
    files = lambda day: len(list((tmp_path / "ledger" / "executions" / f"executed_on=2025-01-0{day}").glob("*.parquet")))
    assert (files(1), files(2)) == (3, 1)
    before = values(ledger.executions(), "execution_id", "control_id", "verdict", "executed_at")
    assert len(before) == 160 and len({r[0] for r in before}) == 160
    ledger.compact(date(2025, 1, 1))
    assert (files(1), files(2)) == (1, 1)
    assert values(ledger.executions(), "execution_id", "control_id", "verdict", "executed_at") == before
    assert ledger.executions(since=date(2025, 1, 2)).count() == 40
    assert "executed_on" not in ledger.executions().columns
