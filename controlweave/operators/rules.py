"""Row rules: for each assertion, the condition a compliant row satisfies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from controlweave.functions.conditions import (
    COMPARE,
    all_of,
    any_of,
    folded,
    is_exception,
    quoted,
    typed_columns,
    typed_operands,
)
from controlweave.operators.joins import equi_join
from controlweave.operators.names import Lineage
from controlweave.operators.population import Joined
from controlweave.plans.spec import (
    ColumnComparison,
    DateMath,
    Referential,
    SpecError,
    TemporalSequence,
    ValueMatch,
)


def value_match(rule: ValueMatch, lineage: Lineage, lenient: bool) -> Column:
    column, expected, op = lineage.column(rule.field), rule.expected_value, rule.operator
    if expected is None:
        return column.isNull() if op == "eq" else column.isNotNull()
    if op in ("contains", "not_contains"):
        fold = folded if rule.ignore_case_and_space else (lambda c: c.cast("string"))
        found = F.contains(fold(column), fold(F.lit(expected)))
        return found if op == "contains" else ~found
    if op in ("in", "not_in"):
        column, values = typed_operands(column, lineage.type_of(rule.field), op, expected, lenient)
        listed = column.isin(*values)
        return listed if op == "in" else ~listed
    if isinstance(expected, str) and rule.ignore_case_and_space:
        return COMPARE[op](folded(column), folded(F.lit(expected)))
    left, right = typed_operands(column, lineage.type_of(rule.field), op, expected, lenient)
    return COMPARE[op](left, right)


def compared(left: str, op: str, right: str, lineage: Lineage, lenient: bool) -> Column:
    pair = typed_columns(
        lineage.column(left), lineage.type_of(left), lineage.column(right), lineage.type_of(right), op, lenient
    )
    return COMPARE[op](*pair)


def temporal_sequence(rule: TemporalSequence, lineage: Lineage, lenient: bool) -> Column:
    events = rule.event_chain
    return all_of(compared(earlier, "lt", later, lineage, lenient) for earlier, later in zip(events, events[1:]))


def date_math(rule: DateMath, lineage: Lineage, lenient: bool) -> Column:
    def as_date(name: str) -> Column:
        column = lineage.column(name)
        return column.try_cast("date") if lenient else column.cast("date")

    limit = F.date_add(as_date(rule.target_date_field), rule.offset_days)
    return COMPARE[rule.operator](as_date(rule.base_date_field), limit)


def column_comparison(rule: ColumnComparison, lineage: Lineage, lenient: bool) -> Column:
    return compared(rule.left_field, rule.operator, rule.right_field, lineage, lenient)


def referential(rule: Referential, lineage: Lineage, lenient: bool) -> Column:
    return quoted(referential_flag(rule)).isNotNull()


def referential_flag(rule: Referential) -> str:
    """Marker column; rules that ask for the same key share it."""
    return f"_found_{rule.foreign_key_field}_in_{rule.reference_dataset}_{rule.reference_key_field}"


# A new rule type is a record in the specification and a builder here.
BUILDERS = {
    ValueMatch: value_match,
    TemporalSequence: temporal_sequence,
    DateMath: date_math,
    ColumnComparison: column_comparison,
    Referential: referential,
}


def compliant(rule, lineage: Lineage, lenient: bool = False) -> Column:
    if type(rule) not in BUILDERS:
        raise SpecError(f"no row rule for {type(rule).__name__}")
    return BUILDERS[type(rule)](rule, lineage, lenient)


def with_references(joined: Joined, rules, catalog) -> Joined:
    """Add, for each referential rule, a marker that is set where the key exists.

    The reference side is reduced to its distinct keys, so the join can neither
    multiply rows nor meet a hot key on its right side.
    """
    frame = joined.frame
    for rule in {referential_flag(r): r for r in rules if isinstance(r, Referential)}.values():
        keys = catalog.frame(rule.reference_dataset)
        key = quoted(Lineage.of(keys, rule.reference_dataset).physical(rule.reference_key_field))
        flag = referential_flag(rule)
        distinct = keys.filter(key.isNotNull()).select(key.alias(flag)).distinct()
        frame = equi_join(
            frame, distinct, [(joined.lineage.physical(rule.foreign_key_field), flag)], "left"
        )
    return Joined(frame, joined.lineage)


def row_exceptions(joined: Joined, rules, catalog, lenient: bool = False) -> DataFrame:
    """Population rows that break at least one rule, in the population's own columns."""
    marked = with_references(joined, rules, catalog)
    broken = any_of(is_exception(compliant(r, marked.lineage, lenient)) for r in rules)
    return marked.frame.filter(broken).select(*[quoted(c) for c in joined.frame.columns])


def rule_ids(broken: dict) -> Column:
    """Ids of the rules whose exception column is true, as an array.

    Joined and split text instead of a filtered array: it stays in generated code.
    """
    mark = "\u0001"
    named = [F.when(x, F.lit(r.assertion_id)) for r, x in broken.items()]
    return F.split(F.concat_ws(mark, *named), mark)


def broken_rules(joined: Joined, rules, catalog, lenient: bool = False) -> DataFrame:
    """Exceptions with the ids of the rules each row breaks, in ``failed_assertions``."""
    marked = with_references(joined, rules, catalog)
    broken = {r: is_exception(compliant(r, marked.lineage, lenient)) for r in rules}
    rows = marked.frame.filter(any_of(broken.values()))
    return rows.select(
        *[quoted(c) for c in joined.frame.columns], rule_ids(broken).alias("failed_assertions")
    )
