import json

import pytest

from controlweave.plans.spec import Control, GroupLimit, JoinLeft, SpecError, read_action, read_assertion

GOVERNANCE = {
    "control_id": "CTRL-1",
    "version": "1.2",
    "owner_role": "Compliance",
    "testing_frequency": "Daily",
    "regulatory_citations": ["SOX 404"],
    "risk_objective": "Stop losses",
}


def document(**changes):
    doc = {
        "governance": GOVERNANCE,
        "ontology_bindings": [
            {"business_term": "Amount", "dataset_alias": "trades", "technical_field": "amount", "data_type": "numeric"}
        ],
        "population": {
            "base_dataset": "trades",
            "steps": [
                {
                    "step_id": "large",
                    "action": {"operation": "filter_comparison", "field": "amount", "operator": "gt", "value": 10},
                },
                {
                    "step_id": "hr",
                    "action": {
                        "operation": "join_left",
                        "left_dataset": "trades",
                        "right_dataset": "roster",
                        "left_keys": ["approver"],
                        "right_keys": ["employee_id"],
                    },
                },
            ],
            "sampling": {"enabled": True, "method": "random", "sample_size": 5},
        },
        "assertions": [
            {
                "assertion_id": "a1",
                "description": "approved",
                "assertion_type": "value_match",
                "field": "status",
                "operator": "eq",
                "expected_value": "APPROVED",
                "materiality_threshold_percent": 2.5,
            }
        ],
        "evidence": {
            "retention_years": 7,
            "reviewer_workflow": "Four_Eyes_Review",
            "exception_routing_queue": "ops",
        },
    }
    doc.update(changes)
    return doc


def test_reads_a_whole_document():
    control = Control.from_dict(document())
    assert control.control_id == "CTRL-1"
    assert control.threshold == 2.5
    assert control.datasets == ("trades", "roster")
    assert control.is_sampled


def test_round_trip_keeps_everything():
    control = Control.from_dict(document())
    assert Control.from_json(control.to_json()) == control
    assert json.loads(control.to_json())["governance"]["regulatory_citations"] == ["SOX 404"]


@pytest.mark.parametrize(
    "path, value",
    [
        (("governance", "testing_frequency"), "Hourly"),
        (("governance", "surprise"), 1),
        (("evidence", "reviewer_workflow"), "Nobody"),
        (("population", "surprise"), 1),
        (("population", "base_dataset"), 5),
    ],
)
def test_refuses_values_outside_the_format(path, value):
    doc = json.loads(json.dumps(document()))
    doc[path[0]][path[1]] = value
    with pytest.raises(SpecError):
        Control.from_dict(doc)


@pytest.mark.parametrize("missing", ["governance", "population", "assertions"])
def test_refuses_missing_sections(missing):
    doc = document()
    del doc[missing]
    with pytest.raises(SpecError, match=missing):
        Control.from_dict(doc)


@pytest.mark.parametrize(
    "body",
    [
        {"operation": "filter_comparison", "field": "x", "operator": "like", "value": 1},
        {"operation": "filter_comparison", "field": "x", "operator": "eq", "value": None},
        {"operation": "filter_comparison", "field": "x", "operator": "eq", "value": True},
        {"operation": "filter_in_list", "field": "x", "values": [None]},
        {"operation": "filter_in_list", "field": "x", "values": []},
        {"operation": "filter_is_null", "field": "x", "is_null": "yes"},
        {"operation": "join_left", "right_dataset": "r", "left_keys": ["a", "b"], "right_keys": ["a"]},
        {"operation": "join_left", "right_dataset": "r", "left_keys": [], "right_keys": []},
        {"operation": "explode", "field": "x"},
        {"operation": "filter_is_null", "field": "x", "is_null": True, "extra": 1},
    ],
)
def test_refuses_bad_actions(body):
    with pytest.raises(SpecError):
        read_action(body, "step")


@pytest.mark.parametrize(
    "body",
    [
        {"assertion_type": "value_match", "field": "x", "operator": "gt", "expected_value": None},
        {"assertion_type": "value_match", "field": "x", "operator": "in", "expected_value": "A"},
        {"assertion_type": "value_match", "field": "x", "operator": "eq", "expected_value": ["A"]},
        {"assertion_type": "value_match", "field": "x", "operator": "in", "expected_value": [1.5]},
        {"assertion_type": "value_match", "field": "x", "operator": "not_in", "expected_value": []},
        {"assertion_type": "value_match", "field": "x", "operator": "contains", "expected_value": 5},
        {"assertion_type": "temporal_sequence", "event_chain": ["only"]},
        {"assertion_type": "temporal_date_math", "base_date_field": "a", "operator": "neq", "target_date_field": "b", "offset_days": 1},
        {"assertion_type": "temporal_date_math", "base_date_field": "a", "operator": "eq", "target_date_field": "b", "offset_days": 1.5},
        {"assertion_type": "aggregation", "group_by_fields": [], "metric_field": "m", "aggregation_function": "SUM", "operator": "gt", "threshold": 1},
        {"assertion_type": "aggregation", "group_by_fields": ["k"], "metric_field": "m", "aggregation_function": "MEDIAN", "operator": "gt", "threshold": 1},
        {"assertion_type": "guess"},
    ],
)
def test_refuses_bad_assertions(body):
    with pytest.raises(SpecError):
        read_assertion({"assertion_id": "a", **body}, "assertion")


def test_older_and_documented_spellings():
    limit = read_assertion(
        {"assertion_id": "a", "assertion_type": "aggregation_sum", "group_by_fields": ["k"],
         "metric_field": "m", "operator": "lte", "threshold": 5},
        "x",
    )
    assert isinstance(limit, GroupLimit) and limit.aggregation_function == "SUM"
    average = read_assertion(
        {"assertion_id": "a", "assertion_type": "aggregate", "aggregation_function": "AVG", "field": "m",
         "group_by_fields": ["k"], "operator": "lte", "threshold_value": 75.0},
        "x",
    )
    assert (average.metric_field, average.threshold) == ("m", 75.0)
    step = read_action(
        {"operation": "join", "join_type": "INNER", "right_dataset": "t",
         "join_conditions": [{"left_field": "a", "right_field": "b"}]},
        "x",
    )
    assert isinstance(step, JoinLeft) and step.join_type == "INNER" and step.left_keys == ("a",)


def test_sampling_rules():
    for sampling in (
        {"enabled": True, "method": "random"},
        {"enabled": True, "method": "stratified", "sample_size": 5},
        {"enabled": True, "method": "judgmental", "sample_size": 5},
        {"enabled": True, "method": "random", "sample_percentage": 5},
        {"enabled": True, "method": "best", "sample_size": 5},
    ):
        doc = document()
        doc["population"] = {**doc["population"], "sampling": sampling}
        with pytest.raises(SpecError):
            Control.from_dict(doc)


def test_steps_need_unique_ids():
    doc = document()
    steps = doc["population"]["steps"]
    doc["population"] = {**doc["population"], "steps": [steps[0], {**steps[1], "step_id": "large"}]}
    with pytest.raises(SpecError, match="unique"):
        Control.from_dict(doc)


def test_dates_and_times_come_back_typed():
    from datetime import date, datetime

    raw = {
        "governance": {"control_id": "C"},
        "population": {
            "base_dataset": "t",
            "steps": [
                {"step_id": f"s{i}", "action": {"operation": "filter_comparison", "field": "f", "operator": "gt", "value": value}}
                for i, value in enumerate([datetime(2024, 1, 2, 3), datetime(2024, 1, 2, 3, 4, 5, 678), date(2024, 1, 2), "2024-01-02", 5, 0.5])
            ],
        },
        "assertions": [],
    }
    control = Control.from_dict(raw)
    assert Control.from_json(control.to_json()) == control
    assert [type(s.action.value) for s in Control.from_json(control.to_json()).steps] == [datetime, datetime, date, str, int, float]
