"""Group rules: one aggregate per group held against a threshold.

Every aggregate here is a plain SUM / COUNT / AVG / MIN / MAX, so Spark combines
on the map side and a hot group costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from controlweave.functions.conditions import COMPARE, all_of, is_exception
from controlweave.operators.names import Lineage
from controlweave.operators.population import Joined
from controlweave.plans.spec import GroupLimit, SpecError

FUNCTIONS = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def measured(rule: GroupLimit, lineage: Lineage) -> Column | None:
    """The metric as a number (a boolean counts its trues), or None for other types."""
    data_type, column = lineage.type_of(rule.metric_field), lineage.column(rule.metric_field)
    if isinstance(data_type, T.BooleanType):
        return column.cast("int")
    return column if data_type is None or isinstance(data_type, T.NumericType) else None


def metric(rule: GroupLimit, lineage: Lineage, where: Column | None = None) -> Column:
    """The aggregate of the rule, over the rows where ``where`` holds."""
    column = measured(rule, lineage)
    if rule.aggregation_function == "COUNT":
        column = lineage.column(rule.metric_field)
    elif column is None:
        raise SpecError(
            f"{rule.assertion_id}: {rule.aggregation_function} of {rule.metric_field} "
            f"({lineage.type_of(rule.metric_field).simpleString()}) cannot be held against a number"
        )
    if where is not None:
        column = F.when(where, column)
    return FUNCTIONS[rule.aggregation_function](column)


def total(rule: GroupLimit, lineage: Lineage) -> Column:
    """Sum of the metric; NULL where the metric is not a number."""
    column = measured(rule, lineage)
    return F.lit(None).cast("double") if column is None else F.sum(column)


def grain(rule: GroupLimit, lineage: Lineage) -> tuple[str, ...]:
    return tuple(dict.fromkeys(lineage.physical(f) for f in rule.group_by_fields))


def fails(rule: GroupLimit, value: Column) -> Column:
    return is_exception(COMPARE[rule.operator](value, F.lit(float(rule.threshold))))


def key_columns(rules, lineage: Lineage) -> list[Column]:
    names = dict.fromkeys(name for rule in rules for name in grain(rule, lineage))
    return [lineage.column(n).alias(n) for n in names]


def failing_groups(joined: Joined, rule: GroupLimit) -> DataFrame:
    """Groups that break one rule: keys, row count, metric and total."""
    lineage = joined.lineage
    return (
        joined.frame.groupBy(*key_columns([rule], lineage))
        .agg(
            F.count(F.lit(1)).alias("exception_count"),
            metric(rule, lineage).alias("metric_value"),
            total(rule, lineage).alias("total_amount"),
        )
        .filter(fails(rule, F.col("metric_value")))
    )


def groups_failing_all(joined: Joined, rules) -> DataFrame:
    """Groups, at the grain of all rules' keys together, that break every rule."""
    lineage = joined.lineage
    values = [metric(r, lineage).alias(f"_metric_{i}") for i, r in enumerate(rules)]
    broken = all_of(fails(r, F.col(f"_metric_{i}")) for i, r in enumerate(rules))
    return (
        joined.frame.groupBy(*key_columns(rules, lineage))
        .agg(
            F.count(F.lit(1)).alias("exception_count"),
            total(rules[0], lineage).alias("total_amount"),
            *values,
        )
        .filter(broken)
        .drop(*[f"_metric_{i}" for i in range(len(rules))])
    )
