"""Predicates and literals shared by filters, assertions and limits."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from controlweave.plans.spec import SpecError

COMPARE = {
    "eq": operator.eq,
    "neq": operator.ne,
    "gt": operator.gt,
    "lt": operator.lt,
    "gte": operator.ge,
    "lte": operator.le,
}


ORDERINGS = ("gt", "lt", "gte", "lte")
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_of(conditions: Iterable[Column]) -> Column:
    found = list(conditions)
    return reduce(operator.and_, found) if found else F.lit(True)


def any_of(conditions: Iterable[Column]) -> Column:
    found = list(conditions)
    return reduce(operator.or_, found) if found else F.lit(False)


def is_exception(condition: Column) -> Column:
    """True where the condition is false or unknown: NULL never complies."""
    return ~F.coalesce(condition, F.lit(False))


def folded(column: Column) -> Column:
    """Text compared without regard to case or outer spaces."""
    return F.trim(F.upper(column.cast("string")))


def sql_text(value: str) -> str:
    """A string literal for a SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value, data_type: T.DataType | None) -> Column:
    """A literal in the column's own type, so comparisons reach the scan uncast."""
    if isinstance(value, (datetime, date)):
        if isinstance(data_type, TEMPORAL):
            target = "timestamp_ntz" if isinstance(data_type, T.DateType) else data_type.simpleString()
            return F.lit(value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)).cast(target)
        return F.lit(value.isoformat())
    return F.lit(value)


def typed_columns(
    left: Column,
    left_type: T.DataType | None,
    right: Column,
    right_type: T.DataType | None,
    op: str,
    lenient: bool = False,
) -> tuple[Column, Column]:
    """Two columns ready to compare. Text has no order against numbers or dates;
    equality reads the text as the other side's kind of value."""

    def as_kind_of(column: Column, other: T.DataType) -> Column:
        kind = "double" if isinstance(other, T.NumericType) else other.simpleString()
        return column.try_cast(kind) if lenient else column.cast(kind)

    def text_against(a: T.DataType | None, b: T.DataType | None) -> bool:
        return isinstance(a, T.StringType) and isinstance(b, (T.NumericType, *TEMPORAL))

    if text_against(left_type, right_type) or text_against(right_type, left_type):
        if op in ORDERINGS:
            raise SpecError(f"cannot order {left_type.simpleString()} against {right_type.simpleString()}")
        if isinstance(left_type, T.StringType):
            return as_kind_of(left, right_type), right
        return left, as_kind_of(right, left_type)
    return left, right


def typed_operands(
    column: Column, data_type: T.DataType | None, op: str, value, lenient: bool = False
) -> tuple[Column, Column]:
    """Both sides of ``column op value``, refusing pairs that have no order.

    Text against a number: ordering is refused when the plan is built; equality
    compares as numbers, so bad text fails the control (or, when lenient, is
    NULL and therefore an exception).
    """
    values = value if isinstance(value, (list, tuple)) else [value]
    numeric = any(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
    if isinstance(data_type, T.StringType) and numeric:
        if op in ORDERINGS:
            raise SpecError(f"cannot order text against the number {value!r}")
        column = column.try_cast("double") if lenient else column.cast("double")
    if isinstance(data_type, TEMPORAL) and numeric:
        raise SpecError(f"cannot compare {data_type.simpleString()} with the number {value!r}")
    if isinstance(data_type, T.BooleanType) and numeric:
        column = column.cast("int")
    if isinstance(value, (list, tuple)):
        return column, value
    return column, literal(value, data_type)
