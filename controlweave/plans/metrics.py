"""Counts that decide verdicts, for any number of controls, in few scans.

Controls with the same base dataset, joins and computed fields are counted in
one pass: their filters and rules become conditional aggregates over the shared
joined rows or, where there are many, an index over all their predicates. Group
rules at one grain share one grouping as well.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from controlweave.functions.conditions import all_of, any_of, is_exception, quoted, sql_text
from controlweave.operators.groups import fails, grain, metric
from controlweave.operators.names import Lineage
from controlweave.operators.population import Joined, build_joined, build_population, filter_column, population_filters
from controlweave.operators.rules import compliant, rule_ids, with_references
from controlweave.operators.sampling import sample
from controlweave.plans.predicates import CONTROLS_PER_INDEX, PredicateIndex, atom_of, covering
from controlweave.plans.spec import FILTERS, Control

# Generated code grows with the number of aggregates and beyond this many is no
# longer compiled by the JVM; more row predicates are counted by an index, and more
# group metrics or exception tables are split over several passes, which share the
# shuffles below them.
PREDICATES_PER_JOB = 32
# Conditions that only Spark can compute, per index.
FLAGS_PER_INDEX = 128
# Up to this many different filters are offered to the scan as one disjunction;
# of more, what covers them all is offered.
FILTERS_TO_SCAN = 16

METRICS = (
    "total_population",
    "sampled_population",
    "row_exceptions",
    "failing_groups",
    "group_population",
)


def sharing_key(control: Control) -> tuple:
    """Controls with equal keys read the same joined rows. Filters may differ."""
    shape = [(s.step_id, s.action) for s in control.steps if not isinstance(s.action, FILTERS)]
    return (control.base_dataset, repr(shape))


@dataclass(frozen=True)
class Member:
    """One control inside a shared scan and the rows it covers; members with equal
    ``filters`` cover the same rows."""

    control: Control
    covered: Column
    filters: tuple = ()


def members_of(controls: list[Control], joined: Joined, lenient: bool) -> list[Member]:
    built: dict[tuple, Column] = {}
    out = []
    for control in controls:
        key = tuple(s.action for s in control.steps if isinstance(s.action, FILTERS))
        if key not in built:
            built[key] = all_of(population_filters(control, joined.lineage, lenient))
        out.append(Member(control, built[key], key))
    return out


def relevant(frame: DataFrame, members: list[Member], lineage: Lineage) -> DataFrame:
    """Rows some member may cover, so selective filters still reach the scan."""
    distinct = {m.filters: m.covered for m in members}
    if not all(distinct):
        return frame
    if len(distinct) <= FILTERS_TO_SCAN:
        return frame.filter(any_of(distinct.values()))
    cover = covering(distinct, lineage)
    return frame if cover is None else frame.filter(cover)


def long_rows(wide: DataFrame, rows: list[dict[str, str]], ids: list[str]) -> DataFrame:
    """One line per control out of one wide aggregate row; ``rows`` name its columns."""
    cells = [
        ", ".join([sql_text(control_id), *(f"cast({row.get(m, 0)} as bigint)" for m in METRICS)])
        for control_id, row in zip(ids, rows)
    ]
    names = ", ".join(["control_id", *METRICS])
    return wide.selectExpr(f"stack({len(ids)}, {', '.join(cells)}) as ({names})")


def chunks(members: list[Member], weight) -> list[list[Member]]:
    out, room = [], 0
    for member in members:
        cost = max(1, weight(member))
        if not out or room < cost:
            out.append([])
            room = PREDICATES_PER_JOB
        out[-1].append(member)
        room -= cost
    return out


def row_metrics(joined: Joined, members: list[Member], catalog, lenient: bool) -> DataFrame:
    """Population and exceptions of every member, in one aggregate over one scan."""
    rules = [r for m in members for r in m.control.row_assertions]
    marked = with_references(joined, list(dict.fromkeys(rules)), catalog)
    populations: dict[tuple, str] = {}  # controls with equal filters share one count
    aggregates, rows = [], []
    for i, m in enumerate(members):
        if m.filters not in populations:
            populations[m.filters] = f"p{i}"
            aggregates.append(F.count_if(m.covered).alias(f"p{i}"))
        broken = any_of(is_exception(compliant(r, marked.lineage, lenient)) for r in m.control.row_assertions)
        aggregates.append(F.count_if(m.covered & broken).alias(f"e{i}"))
        size = populations[m.filters]
        rows.append({"total_population": size, "sampled_population": size, "row_exceptions": f"e{i}"})
    wide = relevant(marked.frame, members, marked.lineage).agg(*aggregates)
    return long_rows(wide, rows, [m.control.control_id for m in members])


def indexed_metrics(joined: Joined, members: list[Member], catalog, lenient: bool) -> DataFrame:
    """Population and exceptions of any number of members over one scan, by a predicate index."""
    rules = [r for m in members for r in m.control.row_assertions]
    marked = with_references(joined, list(dict.fromkeys(rules)), catalog)
    lineage = marked.lineage
    users: dict = defaultdict(list)  # rules that only Spark can compute, and who covers the rows they are asked of
    for m in members:
        for r in m.control.row_assertions:
            if atom_of(r, lineage) is None:
                users[r].append(m.covered)
    index = PredicateIndex(len(members))
    flags: dict = {}
    for i, m in enumerate(members):
        for action in m.filters:
            atom = atom_of(action, lineage) or flags.get(action)
            if atom is None:
                atom = flags[action] = index.flag(filter_column(action, lineage, lenient))
            index.add(i, True, atom)
        for r in m.control.row_assertions:
            atom = atom_of(r, lineage) or flags.get(r)
            if atom is None:
                # a rule is computed on rows that some control asks it of, and can fail on those only
                condition = compliant(r, lineage, lenient)
                condition = F.when(any_of({id(c): c for c in users[r]}.values()), condition)
                atom = flags[r] = index.flag(condition)
            index.add(i, False, atom)
    counted = index.counts(relevant(marked.frame, members, lineage))
    names = F.array(*[F.lit(m.control.control_id) for m in members])
    size = F.coalesce("covered", F.lit(0))
    values = {"total_population": size, "sampled_population": size, "row_exceptions": F.coalesce("broken", F.lit(0))}
    every = counted.sparkSession.range(len(members)).join(counted, F.col("id") == F.col("control"), "left")
    return every.select(
        F.get(names, F.col("id").cast("int")).alias("control_id"),
        *[values.get(m, F.lit(0)).cast("bigint").alias(m) for m in METRICS],
    )


def index_chunks(members: list[Member], lineage: Lineage) -> list[list[Member]]:
    """Members of one index each: nearly always all of them."""
    out, flags = [[]], set()
    for m in members:
        own = {x for x in (*m.filters, *m.control.row_assertions) if atom_of(x, lineage) is None}
        if out[-1] and (len(out[-1]) >= CONTROLS_PER_INDEX or len(flags | own) > FLAGS_PER_INDEX):
            out.append([])
            flags = set()
        out[-1].append(m)
        flags |= own
    return out


def group_metrics(joined: Joined, uses: list[tuple[Member, object, bool]]) -> DataFrame:
    """Failing and existing groups of rules that share one grain.

    A use marked as counting also yields its control's population, since every
    covered row belongs to exactly one group.
    """
    members = list({id(m): m for m, _, _ in uses}.values())
    lineage = joined.lineage
    keys = [lineage.column(k).alias(f"_key_{i}") for i, k in enumerate(grain(uses[0][1], lineage))]
    per_group, totals, rows = [], [], []
    for i, (m, rule, counting) in enumerate(uses):
        present = F.col(f"n{i}") > 0
        per_group += [
            F.count_if(m.covered).alias(f"n{i}"),
            metric(rule, lineage, m.covered).alias(f"m{i}"),
        ]
        totals += [
            F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"p{i}"),
            F.count_if(present).alias(f"g{i}"),
            F.count_if(present & fails(rule, F.col(f"m{i}"))).alias(f"f{i}"),
        ]
        row = {"failing_groups": f"f{i}", "group_population": f"g{i}"}
        if counting:
            row["total_population"] = row["sampled_population"] = f"p{i}"
        rows.append(row)
    wide = relevant(joined.frame, members, lineage).groupBy(*keys).agg(*per_group).agg(*totals)
    return long_rows(wide, rows, [m.control.control_id for m, _, _ in uses])


def exception_rows(controls: list[Control], catalog, lenient: bool = False) -> DataFrame:
    """Row exceptions of controls that share joined rows, all found in one pass.

    Each row comes once per control it breaks, with that ``control_id`` and the ids
    of the broken rules, so the frame can be written partitioned by control.
    """
    joined = build_joined(controls[0], catalog)
    parts = [
        _exception_rows(joined, chunk, catalog, lenient)
        for chunk in chunks(members_of(controls, joined, lenient), lambda m: len(m.control.row_assertions))
    ]
    return reduce(DataFrame.unionByName, parts)


def _exception_rows(joined: Joined, members: list[Member], catalog, lenient: bool) -> DataFrame:
    rules = list(dict.fromkeys(r for m in members for r in m.control.row_assertions))
    marked = with_references(joined, rules, catalog)
    breaks = []
    for m in members:
        broken = {r: is_exception(compliant(r, marked.lineage, lenient)) for r in m.control.row_assertions}
        found = F.struct(
            F.lit(m.control.control_id).alias("control_id"), rule_ids(broken).alias("failed_assertions")
        )
        breaks.append(F.when(m.covered & any_of(broken.values()), found))
    rows = relevant(marked.frame, members, marked.lineage).withColumn("_break", F.explode(F.array(*breaks)))
    rows = rows.filter(F.col("_break").isNotNull())
    taken = ("control_id", "failed_assertions")
    own = [quoted(c).alias(f"{c}_1" if c.lower() in taken else c) for c in joined.frame.columns]
    return rows.select(*own, *[F.col(f"_break.{name}").alias(name) for name in taken])


def sampled_metrics(control: Control, catalog, lenient: bool) -> list[DataFrame]:
    """A sampled control: its rows are tested on the sample, its groups on all rows."""
    joined = build_population(control, catalog, lenient)
    picked = sample(joined, control.sampling, catalog)
    everything = Member(control, F.lit(True))
    full = joined.frame.agg(F.count(F.lit(1)).alias("n"))
    parts = [long_rows(full, [{"total_population": "n"}], [control.control_id])]
    on_sample = row_metrics(picked, [everything], catalog, lenient)
    parts.append(on_sample.withColumn("total_population", F.lit(0).cast("long")))
    for rule in control.group_assertions:
        parts.append(group_metrics(joined, [(everything, rule, False)]))
    return parts


def metric_parts(controls: list[Control], catalog, lenient: bool = False) -> list[DataFrame]:
    """Independent frames of (control_id, metrics…); a control may appear in several."""
    parts: list[DataFrame] = []
    shared = defaultdict(list)
    for control in controls:
        if control.is_sampled:
            parts += sampled_metrics(control, catalog, lenient)
        else:
            shared[sharing_key(control)].append(control)
    for together in shared.values():
        joined = build_joined(together[0], catalog)
        members = members_of(together, joined, lenient)
        by_rows = [m for m in members if m.control.row_assertions or not m.control.group_assertions]
        if sum(max(1, len(m.control.row_assertions)) for m in by_rows) <= PREDICATES_PER_JOB:
            if by_rows:
                parts.append(row_metrics(joined, by_rows, catalog, lenient))
        else:
            parts += [indexed_metrics(joined, chunk, catalog, lenient) for chunk in index_chunks(by_rows, joined.lineage)]
        by_grain = defaultdict(list)
        for m in members:
            for i, rule in enumerate(m.control.group_assertions):
                counting = i == 0 and not m.control.row_assertions
                by_grain[tuple(sorted(grain(rule, joined.lineage)))].append((m, rule, counting))
        for uses in by_grain.values():
            for start in range(0, len(uses), PREDICATES_PER_JOB):
                parts.append(group_metrics(joined, uses[start : start + PREDICATES_PER_JOB]))
    return parts


def metrics(controls: list[Control], catalog, lenient: bool = False) -> DataFrame:
    """One row of counts per control."""
    parts = metric_parts(controls, catalog, lenient)
    frame = reduce(DataFrame.unionByName, parts)
    if len(parts) == 1 and not any(len(c.group_assertions) > 1 for c in controls):
        return frame
    return frame.groupBy("control_id").agg(*[F.sum(m).alias(m) for m in METRICS])
