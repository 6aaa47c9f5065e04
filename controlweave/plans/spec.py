"""Control specifications: small frozen records read from JSON-like dicts.

A specification is driver-side metadata. Unknown fields, missing fields, wrong
types and values outside a closed list are refused when the record is read, so
a control that reaches the DataFrame builders is structurally sound.
"""

from __future__ import annotations

import json
from dataclasses import MISSING, asdict, dataclass, field, fields
from datetime import date, datetime
from typing import Any, ClassVar

# Fixed values of the control format.
ORDERED_OPERATORS = ("eq", "neq", "gt", "lt", "gte", "lte")
LIMIT_OPERATORS = ("gt", "lt", "eq", "gte", "lte")
MATCH_OPERATORS = ORDERED_OPERATORS + ("in", "not_in", "contains", "not_contains")
AGGREGATES = ("SUM", "COUNT", "AVG", "MIN", "MAX")
FREQUENCIES = ("Continuous", "Daily", "Weekly", "Quarterly", "Annual")
DATA_TYPES = ("string", "numeric", "timestamp", "boolean", "date")
SAMPLING_METHODS = ("random", "stratified", "systematic", "judgmental", "statistical")
REVIEWER_WORKFLOWS = ("Auto-Close_If_Pass", "Requires_Human_Signoff", "Four_Eyes_Review")
JOIN_TYPES = ("LEFT", "INNER")


class SpecError(ValueError):
    """The control document itself is wrong, whatever the data holds."""


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _is_scalar(value: Any) -> bool:
    return isinstance(value, (str, datetime, date)) or _is_number(value)


def _list_of(test):
    return lambda value: isinstance(value, (list, tuple)) and all(map(test, value))


def _is_expected(value: Any) -> bool:
    if value is None or isinstance(value, (str, bool)) or _is_number(value):
        return True
    return _list_of(lambda v: isinstance(v, str))(value) or _list_of(
        lambda v: isinstance(v, int) and not isinstance(v, bool)
    )(value)


KINDS = {
    "text": lambda v: isinstance(v, str),
    "flag": lambda v: isinstance(v, bool),
    "whole": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": _is_number,
    "names": _list_of(lambda v: isinstance(v, str)),
    "scalar": _is_scalar,
    "scalars": _list_of(lambda v: isinstance(v, str) or _is_number(v)),
    "expected": _is_expected,
}


def entry(kind: str, default: Any = MISSING, choices: tuple = (), optional: bool = False):
    """A dataclass field that knows how to check the JSON value it is given."""
    meta = {"kind": kind, "choices": choices, "optional": optional}
    if default is MISSING:
        return field(metadata=meta)
    return field(default=default, metadata=meta)


def read_record(cls: type, raw: Any, where: str):
    """Build one closed record, naming the exact place of any mistake."""
    if isinstance(raw, cls):
        return raw
    if not isinstance(raw, dict):
        raise SpecError(f"{where}: expected an object, got {type(raw).__name__}")
    known = {f.name: f for f in fields(cls)}
    extra = sorted(set(raw) - set(known))
    if extra:
        raise SpecError(f"{where}: unknown field(s) {', '.join(extra)}")
    values = {}
    for name, spec in known.items():
        if name not in raw:
            if spec.default is MISSING and spec.default_factory is MISSING:
                raise SpecError(f"{where}: field '{name}' is required")
            continue
        value = raw[name]
        meta = spec.metadata
        if value is None and meta["optional"]:
            values[name] = None
            continue
        if not KINDS[meta["kind"]](value):
            raise SpecError(f"{where}.{name}: {value!r} is not a valid {meta['kind']} value")
        if meta["choices"] and value not in meta["choices"]:
            raise SpecError(f"{where}.{name}: {value!r} is not one of {', '.join(meta['choices'])}")
        values[name] = tuple(value) if isinstance(value, list) else value
    return cls(**values)


# --- governance and evidence requirements: carried along, not acted on ---------


@dataclass(frozen=True)
class Governance:
    control_id: str = entry("text")
    version: str = entry("text", "1.0")
    owner_role: str = entry("text", "")
    testing_frequency: str = entry("text", "Daily", FREQUENCIES)
    regulatory_citations: tuple = entry("names", ())
    risk_objective: str = entry("text", "")


@dataclass(frozen=True)
class Binding:
    business_term: str = entry("text")
    dataset_alias: str = entry("text")
    technical_field: str = entry("text")
    data_type: str = entry("text", choices=DATA_TYPES)


@dataclass(frozen=True)
class EvidenceRequirements:
    reviewer_workflow: str = entry("text", "Requires_Human_Signoff", REVIEWER_WORKFLOWS)
    exception_routing_queue: str = entry("text", "")
    retention_years: int = entry("whole", 7)


# --- population ----------------------------------------------------------------


@dataclass(frozen=True)
class FilterComparison:
    operation: ClassVar[str] = "filter_comparison"
    field: str = entry("text")
    operator: str = entry("text", choices=ORDERED_OPERATORS)
    value: Any = entry("scalar")


@dataclass(frozen=True)
class FilterInList:
    operation: ClassVar[str] = "filter_in_list"
    field: str = entry("text")
    values: tuple = entry("scalars")

    def __post_init__(self):
        if not self.values:
            raise SpecError(f"filter on '{self.field}': the list must not be empty")


@dataclass(frozen=True)
class FilterIsNull:
    operation: ClassVar[str] = "filter_is_null"
    field: str = entry("text")
    is_null: bool = entry("flag")


@dataclass(frozen=True)
class FilterExpression:
    operation: ClassVar[str] = "filter"
    filter_expression: str = entry("text")


@dataclass(frozen=True)
class JoinLeft:
    """Equi join of the running population with another dataset.

    ``latest_by`` first keeps only the newest right row per key, which is how
    "the most recent assessment" is asked for.
    """

    operation: ClassVar[str] = "join_left"
    right_dataset: str = entry("text")
    left_keys: tuple = entry("names")
    right_keys: tuple = entry("names")
    left_dataset: str = entry("text", "")
    join_type: str = entry("text", "LEFT", JOIN_TYPES)
    latest_by: tuple = entry("names", ())

    def __post_init__(self):
        if not self.left_keys or len(self.left_keys) != len(self.right_keys):
            raise SpecError(
                f"join with '{self.right_dataset}': left_keys and right_keys must be "
                "non-empty and of equal length"
            )


@dataclass(frozen=True)
class ComputedField:
    operation: ClassVar[str] = "computed_field"
    new_field_name: str = entry("text")
    expression: str = entry("text")


ACTIONS = {
    cls.operation: cls
    for cls in (
        FilterComparison,
        FilterInList,
        FilterIsNull,
        FilterExpression,
        JoinLeft,
        ComputedField,
    )
}
FILTERS = (FilterComparison, FilterInList, FilterIsNull, FilterExpression)


@dataclass(frozen=True)
class Step:
    step_id: str
    action: Any


@dataclass(frozen=True)
class Sampling:
    """How many population rows are tested, and which.

    ``sample_key`` names columns that identify a row; without it every column
    takes part, so rows that tie are identical and interchangeable.
    """

    enabled: bool = entry("flag", False)
    method: str = entry("text", "random", SAMPLING_METHODS)
    sample_size: int | None = entry("whole", None, optional=True)
    sample_percentage: float | None = entry("number", None, optional=True)
    stratification_field: str | None = entry("text", None, optional=True)
    random_seed: int | None = entry("whole", 42, optional=True)
    justification: str = entry("text", "")
    sample_key: tuple = entry("names", ())
    selection_dataset: str | None = entry("text", None, optional=True)
    confidence_level: float = entry("number", 0.95)
    precision: float = entry("number", 0.05)
    min_sample_size: int = entry("whole", 1)
    max_sample_size: int | None = entry("whole", None, optional=True)

    def __post_init__(self):
        if not self.enabled:
            return
        if self.sample_size is not None and self.sample_size < 0:
            raise SpecError("sampling.sample_size must not be negative")
        if self.sample_percentage is not None and not 0 <= self.sample_percentage <= 1:
            raise SpecError("sampling.sample_percentage is a fraction between 0 and 1")
        if self.method in ("random", "stratified", "systematic"):
            if not self.sample_size and not self.sample_percentage:
                raise SpecError(f"{self.method} sampling needs sample_size or sample_percentage")
        if self.method == "stratified" and not self.stratification_field:
            raise SpecError("stratified sampling needs stratification_field")
        if self.method == "judgmental" and not (self.selection_dataset and self.sample_key):
            raise SpecError("judgmental sampling needs selection_dataset and sample_key")
        if not 0 < self.confidence_level < 1 or not 0 < self.precision < 1:
            raise SpecError("confidence_level and precision lie strictly between 0 and 1")


# --- assertions: what a compliant row or group satisfies -------------------------


@dataclass(frozen=True)
class ValueMatch:
    assertion_type: ClassVar[str] = "value_match"
    assertion_id: str = entry("text")
    field: str = entry("text")
    operator: str = entry("text", choices=MATCH_OPERATORS)
    expected_value: Any = entry("expected")
    description: str = entry("text", "")
    materiality_threshold_percent: float = entry("number", 0.0)
    ignore_case_and_space: bool = entry("flag", True)

    def __post_init__(self):
        is_list = isinstance(self.expected_value, (list, tuple))
        if self.expected_value is None and self.operator not in ("eq", "neq"):
            raise SpecError(f"{self.assertion_id}: only eq and neq compare with null")
        if is_list != (self.operator in ("in", "not_in")):
            raise SpecError(f"{self.assertion_id}: in / not_in take a list, other operators a scalar")
        if is_list and not self.expected_value:
            raise SpecError(f"{self.assertion_id}: the list must not be empty")
        if self.operator in ("contains", "not_contains") and not isinstance(self.expected_value, str):
            raise SpecError(f"{self.assertion_id}: {self.operator} takes text")


@dataclass(frozen=True)
class TemporalSequence:
    assertion_type: ClassVar[str] = "temporal_sequence"
    assertion_id: str = entry("text")
    event_chain: tuple = entry("names")
    description: str = entry("text", "")
    materiality_threshold_percent: float = entry("number", 0.0)

    def __post_init__(self):
        if len(self.event_chain) < 2:
            raise SpecError(f"{self.assertion_id}: a sequence needs at least two events")


@dataclass(frozen=True)
class DateMath:
    assertion_type: ClassVar[str] = "temporal_date_math"
    assertion_id: str = entry("text")
    base_date_field: str = entry("text")
    operator: str = entry("text", choices=LIMIT_OPERATORS)
    target_date_field: str = entry("text")
    offset_days: int = entry("whole")
    description: str = entry("text", "")
    materiality_threshold_percent: float = entry("number", 0.0)


@dataclass(frozen=True)
class ColumnComparison:
    assertion_type: ClassVar[str] = "column_comparison"
    assertion_id: str = entry("text")
    left_field: str = entry("text")
    operator: str = entry("text", choices=ORDERED_OPERATORS)
    right_field: str = entry("text")
    description: str = entry("text", "")
    materiality_threshold_percent: float = entry("number", 0.0)


@dataclass(frozen=True)
class Referential:
    """Every foreign key must exist in the reference dataset."""

    assertion_type: ClassVar[str] = "referential"
    assertion_id: str = entry("text")
    foreign_key_field: str = entry("text")
    reference_dataset: str = entry("text")
    reference_key_field: str = entry("text")
    description: str = entry("text", "")
    materiality_threshold_percent: float = entry("number", 0.0)


@dataclass(frozen=True)
class GroupLimit:
    """One aggregate per group, held against a threshold."""

    assertion_type: ClassVar[str] = "aggregation"
    assertion_id: str = entry("text")
    group_by_fields: tuple = entry("names")
    metric_field: str = entry("text")
    operator: str = entry("text", choices=LIMIT_OPERATORS)
    threshold: float = entry("number")
    aggregation_function: str = entry("text", choices=AGGREGATES)
    description: str = entry("text", "")
    materiality_threshold_percent: float = entry("number", 0.0)

    def __post_init__(self):
        if not self.group_by_fields:
            raise SpecError(f"{self.assertion_id}: group_by_fields must not be empty")


ASSERTIONS = {
    cls.assertion_type: cls
    for cls in (ValueMatch, TemporalSequence, DateMath, ColumnComparison, Referential, GroupLimit)
}


def _read_tagged(raw: Any, tag: str, choices: dict, where: str):
    if not isinstance(raw, dict):
        raise SpecError(f"{where}: expected an object, got {type(raw).__name__}")
    body = dict(raw)
    kind = body.pop(tag, None)
    if kind not in choices:
        raise SpecError(f"{where}.{tag}: {kind!r} is not one of {', '.join(choices)}")
    return read_record(choices[kind], body, where)


def read_action(raw: Any, where: str):
    """A population step; the documented ``join`` spelling becomes a JoinLeft."""
    if isinstance(raw, dict) and raw.get("operation") == "join":
        pairs = raw.get("join_conditions") or []
        try:
            lefts = [pair["left_field"] for pair in pairs]
            rights = [pair["right_field"] for pair in pairs]
        except (KeyError, TypeError) as error:
            raise SpecError(f"{where}.join_conditions: left_field and right_field are required") from error
        body = {k: v for k, v in raw.items() if k not in ("operation", "join_conditions")}
        return read_record(JoinLeft, {**body, "left_keys": lefts, "right_keys": rights}, where)
    return _read_tagged(raw, "operation", ACTIONS, where)


def read_assertion(raw: Any, where: str):
    """An assertion; older and documented spellings map onto the current ones."""
    if isinstance(raw, dict):
        kind = raw.get("assertion_type")
        if kind == "aggregation_sum":
            if "aggregation_function" in raw:
                raise SpecError(f"{where}: aggregation_sum has no aggregation_function")
            raw = {**raw, "assertion_type": "aggregation", "aggregation_function": "SUM"}
        elif kind == "aggregate":
            renamed = {"field": "metric_field", "threshold_value": "threshold"}
            raw = {renamed.get(k, k): v for k, v in raw.items()}
            raw["assertion_type"] = "aggregation"
        elif kind == "column_to_column":
            raw = {**raw, "assertion_type": "column_comparison"}
    return _read_tagged(raw, "assertion_type", ASSERTIONS, where)


def read_sampling(raw: Any) -> Sampling | None:
    if raw is None:
        return None
    if isinstance(raw, dict) and "sample_type" in raw:
        raw = {("method" if k == "sample_type" else k): v for k, v in raw.items()}
    return read_record(Sampling, raw, "population.sampling")


def _tagged(value: date) -> dict:
    """A date or time as an object that tells its type."""
    return {"$datetime" if isinstance(value, datetime) else "$date": value.isoformat()}


def _untagged(found: dict) -> Any:
    for tag, kind in (("$datetime", datetime), ("$date", date)):
        if set(found) == {tag}:
            return kind.fromisoformat(found[tag])
    return found


@dataclass(frozen=True)
class Control:
    """A whole control: who owns it, what it covers, what must hold."""

    governance: Governance
    base_dataset: str
    steps: tuple
    assertions: tuple
    sampling: Sampling | None = None
    bindings: tuple = ()
    evidence: EvidenceRequirements = EvidenceRequirements()

    @property
    def control_id(self) -> str:
        return self.governance.control_id

    @property
    def row_assertions(self) -> tuple:
        return tuple(a for a in self.assertions if not isinstance(a, GroupLimit))

    @property
    def group_assertions(self) -> tuple:
        return tuple(a for a in self.assertions if isinstance(a, GroupLimit))

    @property
    def threshold(self) -> float:
        return float(max((a.materiality_threshold_percent for a in self.assertions), default=0.0))

    @property
    def is_sampled(self) -> bool:
        return bool(self.sampling and self.sampling.enabled)

    @property
    def datasets(self) -> tuple:
        """Every alias the control reads, base first."""
        names = [self.base_dataset]
        names += [s.action.right_dataset for s in self.steps if isinstance(s.action, JoinLeft)]
        names += [a.reference_dataset for a in self.assertions if isinstance(a, Referential)]
        if self.is_sampled and self.sampling.selection_dataset:
            names.append(self.sampling.selection_dataset)
        return tuple(dict.fromkeys(names))

    @classmethod
    def from_dict(cls, raw: dict) -> Control:
        if not isinstance(raw, dict):
            raise SpecError("a control is an object")
        allowed = {"governance", "ontology_bindings", "population", "assertions", "evidence"}
        extra = sorted(set(raw) - allowed)
        if extra:
            raise SpecError(f"control: unknown field(s) {', '.join(extra)}")
        for name in ("governance", "population", "assertions"):
            if name not in raw:
                raise SpecError(f"control: field '{name}' is required")
        pop = raw["population"]
        extra = sorted(set(pop) - {"base_dataset", "steps", "sampling"})
        if extra or not isinstance(pop.get("base_dataset"), str):
            raise SpecError(f"population: base_dataset is required; unknown field(s): {extra}")
        steps = []
        for i, step in enumerate(pop.get("steps") or []):
            where = f"population.steps[{i}]"
            if not isinstance(step, dict) or set(step) != {"step_id", "action"}:
                raise SpecError(f"{where}: a step has exactly step_id and action")
            steps.append(Step(step["step_id"], read_action(step["action"], where)))
        if len({s.step_id for s in steps}) != len(steps):
            raise SpecError("population.steps: step_id values must be unique")
        return cls(
            governance=read_record(Governance, raw["governance"], "governance"),
            base_dataset=pop["base_dataset"],
            steps=tuple(steps),
            assertions=tuple(
                read_assertion(a, f"assertions[{i}]") for i, a in enumerate(raw["assertions"])
            ),
            sampling=read_sampling(pop.get("sampling")),
            bindings=tuple(
                read_record(Binding, b, f"ontology_bindings[{i}]")
                for i, b in enumerate(raw.get("ontology_bindings") or [])
            ),
            evidence=read_record(EvidenceRequirements, raw.get("evidence") or {}, "evidence"),
        )

    @classmethod
    def from_json(cls, text: str) -> Control:
        return cls.from_dict(json.loads(text, object_hook=_untagged))

    def to_dict(self) -> dict:
        sampling = {"sampling": asdict(self.sampling)} if self.sampling else {}
        return {
            "governance": asdict(self.governance),
            "ontology_bindings": [asdict(b) for b in self.bindings],
            "population": {
                "base_dataset": self.base_dataset,
                "steps": [
                    {
                        "step_id": s.step_id,
                        "action": {"operation": s.action.operation, **asdict(s.action)},
                    }
                    for s in self.steps
                ],
                **sampling,
            },
            "assertions": [
                {"assertion_type": a.assertion_type, **asdict(a)} for a in self.assertions
            ],
            "evidence": asdict(self.evidence),
        }

    def to_json(self) -> str:
        """JSON from which ``from_json`` makes an equal control: dates and times are tagged."""
        return json.dumps(self.to_dict(), default=_tagged, sort_keys=True)
