"""All registered queries by name."""

from __future__ import annotations

from controlweave.workload import business, evidence, grouped, ledgers, populations, reports, rows, samples, streams
from controlweave.workload.common import Query

MODULES = (populations, rows, grouped, samples, reports, evidence, ledgers, streams, business)


def registered() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in MODULES:
        twice = set(out) & set(module.QUERIES)
        if twice:
            raise ValueError(f"query names used twice: {sorted(twice)}")
        out.update(module.QUERIES)
    return out
