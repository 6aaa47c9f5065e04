"""Helpers the registered queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from controlweave.plans.run import population, report
from controlweave.plans.spec import Control
from controlweave.session import tuned
from controlweave.sources.catalog import Catalog


@dataclass(frozen=True)
class Query:
    """A query over the tables of a folder, and the SQL that states its result."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    tuned(spark)
    return Catalog({name: table(spark, sf_dir, name) for name in names})


def control(base: str, steps=(), rules=(), sampling=None, control_id="CTRL", bindings=()) -> Control:
    """A control from short forms: steps are actions (named s1, s2, …) or (id, action)."""
    named = [s if isinstance(s, tuple) else (f"s{i}", s) for i, s in enumerate(steps, 1)]
    return Control.from_dict(
        {
            "governance": {"control_id": control_id},
            "ontology_bindings": list(bindings),
            "population": {
                "base_dataset": base,
                "steps": [{"step_id": i, "action": a} for i, a in named],
                "sampling": sampling,
            },
            "assertions": list(rules),
        }
    )


def keep(field: str, operator: str, value) -> dict:
    return {"operation": "filter_comparison", "field": field, "operator": operator, "value": value}


def keep_in(field: str, *values) -> dict:
    return {"operation": "filter_in_list", "field": field, "values": list(values)}


def keep_null(field: str, is_null: bool) -> dict:
    return {"operation": "filter_is_null", "field": field, "is_null": is_null}


def join(right: str, left_keys, right_keys, **more) -> dict:
    as_list = lambda k: [k] if isinstance(k, str) else list(k)
    return {
        "operation": "join_left",
        "right_dataset": right,
        "left_keys": as_list(left_keys),
        "right_keys": as_list(right_keys),
        **more,
    }


def computed(name: str, expression: str) -> dict:
    return {"operation": "computed_field", "new_field_name": name, "expression": expression}


def rule(kind: str, assertion_id: str = "r1", materiality: float = 0.0, **body) -> dict:
    return {
        "assertion_id": assertion_id,
        "assertion_type": kind,
        "materiality_threshold_percent": materiality,
        **body,
    }


def match(field: str, operator: str, expected, assertion_id: str = "r1", **more) -> dict:
    return rule(
        "value_match", assertion_id, more.pop("threshold", 0.0),
        field=field, operator=operator, expected_value=expected, **more,
    )


def covered(names: tuple[str, ...], spec: Control) -> Callable[[SparkSession, str], DataFrame]:
    """The query that lists a control's population."""
    return lambda spark, sf_dir: population(spec, tables(spark, sf_dir, *names)).frame


REPORT_COLUMNS = [
    "control_id",
    "verdict",
    "exception_count",
    "total_population",
    "sampled_population",
    "exception_rate_percent",
    "materiality_threshold_percent",
    "group_population",
    "group_exception_rate_percent",
]


def verdicts(controls: list[Control], catalog: Catalog) -> DataFrame:
    return report(controls, catalog).select(*REPORT_COLUMNS)


def report_sql(control_id: str, counts: str, threshold: float = 0.0) -> str:
    """One report row from a query giving p (population), e (exceptions) and, for
    group rules, g (groups); every exception is a row exception unless g is given."""
    return f"""
SELECT '{control_id}' AS control_id,
       CASE WHEN p = 0 THEN 'ERROR'
            WHEN CAST(e AS DOUBLE) / p * 100 <= {threshold} THEN 'PASS' ELSE 'FAIL' END AS verdict,
       CAST(e AS BIGINT) AS exception_count,
       CAST(p AS BIGINT) AS total_population,
       CAST(p AS BIGINT) AS sampled_population,
       CASE WHEN p > 0 THEN round(CAST(e AS DOUBLE) / p * 100, 2) END AS exception_rate_percent,
       CAST({threshold} AS DOUBLE) AS materiality_threshold_percent,
       CAST(g AS BIGINT) AS group_population,
       CASE WHEN g > 0 THEN round(CAST(e AS DOUBLE) / g * 100, 2) END AS group_exception_rate_percent
FROM ({counts}) AS counted"""


def row_counts_sql(source: str, compliant: str) -> str:
    """Counts for :func:`report_sql` when the rules are row rules."""
    return f"SELECT count(*) AS p, count(*) FILTER (WHERE ({compliant}) IS NOT TRUE) AS e, 0 AS g FROM {source}"


def group_counts_sql(source: str, keys: str, compliant: str) -> str:
    """Counts for :func:`report_sql` when the one rule is a group rule."""
    return f"""SELECT coalesce(sum(n), 0) AS p, count(*) FILTER (WHERE ok IS NOT TRUE) AS e, count(*) AS g
FROM (SELECT count(*) AS n, ({compliant}) AS ok FROM {source} GROUP BY {keys}) AS grouped"""
