"""controlweave: compliance control testing as plain Spark DataFrame plans."""

from controlweave.plans.run import (
    attribution,
    dry_run,
    exceptions,
    population,
    report,
    run_control,
    run_controls,
    schema_drift,
)
from controlweave.plans.spec import Control, SpecError
from controlweave.sources.catalog import Catalog

__all__ = [
    "Catalog",
    "Control",
    "SpecError",
    "attribution",
    "dry_run",
    "exceptions",
    "population",
    "report",
    "run_control",
    "run_controls",
    "schema_drift",
]
