"""From a control's steps to the rows it covers."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame

from controlweave.functions.conditions import COMPARE, all_of, quoted, typed_operands
from controlweave.operators.joins import equi_join, latest_per_key
from controlweave.operators.names import Lineage
from controlweave.plans.spec import (
    FILTERS,
    ComputedField,
    Control,
    FilterComparison,
    FilterExpression,
    FilterInList,
    FilterIsNull,
    JoinLeft,
    SpecError,
)


@dataclass(frozen=True)
class Joined:
    """The base dataset with every join and computed field applied, unfiltered."""

    frame: DataFrame
    lineage: Lineage


def filter_column(action, lineage: Lineage, lenient: bool = False) -> Column:
    """One population filter. NULL drops the row, as in any WHERE clause."""
    if isinstance(action, FilterComparison):
        left, right = typed_operands(
            lineage.column(action.field),
            lineage.type_of(action.field),
            action.operator,
            action.value,
            lenient,
        )
        return COMPARE[action.operator](left, right)
    if isinstance(action, FilterInList):
        column, values = typed_operands(
            lineage.column(action.field), lineage.type_of(action.field), "in", action.values, lenient
        )
        return column.isin(*values)
    if isinstance(action, FilterIsNull):
        column = lineage.column(action.field)
        return column.isNull() if action.is_null else column.isNotNull()
    if isinstance(action, FilterExpression):
        return lineage.expression(action.filter_expression)
    raise SpecError(f"{type(action).__name__} is not a filter")


def add_join(current: Joined, step_id: str, action: JoinLeft, catalog) -> Joined:
    right = catalog.frame(action.right_dataset)
    right_lineage = Lineage.of(right, action.right_dataset)
    keys = [right_lineage.physical(k) for k in action.right_keys]
    if action.latest_by:
        right = latest_per_key(right, keys, [right_lineage.physical(c) for c in action.latest_by])
        rows_per_key = 1
    else:
        rows_per_key = catalog.rows_per_key(action.right_dataset, keys)

    names: dict[str, str] = {}
    taken: set[str] = set()
    for own in right.columns:
        if own in keys:
            wanted = f"{step_id}_{own}"
            physical = current.lineage.free_name(wanted, taken)
            if physical != wanted:
                raise SpecError(f"join '{step_id}': column '{wanted}' exists already")
        else:
            physical = current.lineage.free_name(own, taken)
        names[own] = physical
        taken.add(physical.lower())

    # Non-key columns first, keys last, as the joined row has always been laid out.
    order = [c for c in right.columns if c not in keys] + list(dict.fromkeys(keys))
    renamed = right.select(*[quoted(c).alias(names[c]) for c in order])
    pairs = [(current.lineage.physical(l), names[k]) for l, k in zip(action.left_keys, keys)]
    frame = equi_join(current.frame, renamed, pairs, action.join_type.lower(), rows_per_key)
    types = {names[c]: right_lineage.types[c] for c in order}
    return Joined(frame, current.lineage.joined(types, names, (action.right_dataset, step_id)))


def build_joined(control: Control, catalog) -> Joined:
    base = catalog.frame(control.base_dataset)
    current = Joined(base, Lineage.of(base, control.base_dataset))
    for step in control.steps:
        action = step.action
        if isinstance(action, JoinLeft):
            current = add_join(current, step.step_id, action, catalog)
        elif isinstance(action, ComputedField):
            name = action.new_field_name
            if name.lower() in {n.lower() for n in current.lineage.types}:
                raise SpecError(f"computed field '{name}' exists already")
            frame = current.frame.withColumn(name, current.lineage.expression(action.expression))
            current = Joined(frame, current.lineage.with_column(name, frame.schema[name].dataType))
        elif not isinstance(action, FILTERS):
            raise SpecError(f"step '{step.step_id}' has no known action")
    return current


def population_filters(control: Control, lineage: Lineage, lenient: bool = False) -> list[Column]:
    """All filters, resolved on the joined row whatever their place among the steps."""
    return [
        filter_column(s.action, lineage, lenient) for s in control.steps if isinstance(s.action, FILTERS)
    ]


def build_population(control: Control, catalog, lenient: bool = False) -> Joined:
    """The filtered population. Catalyst moves the filters down to the scans."""
    joined = build_joined(control, catalog)
    filters = population_filters(control, joined.lineage, lenient)
    return replace(joined, frame=joined.frame.filter(all_of(filters)) if filters else joined.frame)
