"""An index over the predicates of many controls, and what their filters have in common.

Most filters and rules compare one column with constants. All constants that controls name for a
column, sorted, cut its values into cells: below the first, equal to it, between the first and the
second, and so on; absent values have a cell of their own. Whether a comparison holds depends on the cell
alone, so a row's verdicts on all controls are the AND of one bit string per column, found by
binary search (numbers and times) or hash (text). Predicates of any other form are computed by Spark
and enter as columns of ones and zeros.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from controlweave.functions.conditions import all_of, any_of, folded, literal, quoted
from controlweave.operators.names import Lineage
from controlweave.plans.spec import FilterComparison, FilterInList, FilterIsNull, ValueMatch

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
EPOCH = datetime(1970, 1, 1)
#: Controls of one index: its bit strings take about cells x controls / 8 bytes per column.
CONTROLS_PER_INDEX = 2048
#: Cells of a row's bit strings that are counted at once.
BITS_AT_ONCE = 1 << 22
#: Ranges per column, and texts, that a covering offers to the scan.
RANGES, TEXTS = 16, 200


@dataclass(frozen=True)
class Atom:
    """A comparison of one column with constants, all of one kind."""

    kind: str  # whole, real, time, text or folded (text without case and outer spaces)
    column: str
    op: str  # a comparison, in, not_in, null or not_null
    values: tuple = ()


def _micros(value: date) -> int:
    moment = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
    return (moment - EPOCH) // timedelta(microseconds=1)


def comparison(field: str, op: str, value, lineage: Lineage, fold: bool = False) -> Atom | None:
    """The atom of ``field op value``, or None where only Spark's own comparison will do."""
    values = tuple(value) if isinstance(value, (list, tuple)) else (value,)
    kind, column = lineage.type_of(field), lineage.physical(field)
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63
    if isinstance(kind, WHOLE) and all(map(whole, values)):
        return Atom("whole", column, op, values)
    if isinstance(kind, (*WHOLE, T.DoubleType)) and all(whole(v) or isinstance(v, float) and not math.isnan(v) for v in values):
        return Atom("real", column, op, tuple(map(float, values)))
    if kind == T.StringType() and op in ("eq", "neq", "in", "not_in") and all(isinstance(v, str) for v in values):
        if not fold:
            return Atom("text", column, op, values)
        if all(v.isascii() for v in values):
            return Atom("folded", column, op, tuple(v.upper().strip(" ") for v in values))
    if isinstance(kind, (T.DateType, T.TimestampNTZType)) and all(isinstance(v, date) and getattr(v, "tzinfo", None) is None for v in values):
        return Atom("time", column, op, tuple(map(_micros, values)))
    return None


def _presence(field: str, null: bool, lineage: Lineage) -> Atom | None:
    kind, column = lineage.type_of(field), lineage.physical(field)
    for name, types in (("whole", WHOLE), ("real", T.DoubleType), ("text", T.StringType), ("time", (T.DateType, T.TimestampNTZType))):
        if isinstance(kind, types):
            return Atom(name, column, "null" if null else "not_null")
    return None


def atom_of(item, lineage: Lineage) -> Atom | None:
    """The atom of a filter or a row rule, if it has that form."""
    if isinstance(item, FilterComparison):
        return comparison(item.field, item.operator, item.value, lineage)
    if isinstance(item, FilterInList):
        return comparison(item.field, "in", item.values, lineage)
    if isinstance(item, FilterIsNull):
        return _presence(item.field, item.is_null, lineage)
    if isinstance(item, ValueMatch):
        if item.expected_value is None:
            return _presence(item.field, item.operator == "eq", lineage)
        # a list is compared as it is
        fold = isinstance(item.expected_value, str) and item.ignore_case_and_space
        if item.operator not in ("contains", "not_contains"):
            return comparison(item.field, item.operator, item.expected_value, lineage, fold)
    return None


def _holds(atom: Atom, place: dict, cells: int) -> np.ndarray:
    """In which cells the atom is true; the last cell is that of absent values."""
    cell = np.arange(cells)
    at = [2 * place[v] + 1 for v in atom.values]
    found = {
        "eq": lambda: cell == at[0], "neq": lambda: cell != at[0], "lt": lambda: cell < at[0], "lte": lambda: cell <= at[0],
        "gt": lambda: cell > at[0], "gte": lambda: cell >= at[0], "in": lambda: np.isin(cell, at),
        "not_in": lambda: ~np.isin(cell, at), "null": lambda: cell < 0, "not_null": lambda: cell >= 0,
    }[atom.op]()
    found[-1] = atom.op == "null"
    return found


class PredicateIndex:
    """For each control (by number), atoms that decide which rows it covers and which comply."""

    def __init__(self, controls: int) -> None:
        self.controls = controls
        self.atoms: dict[tuple[str, str], list[tuple[bool, int, Atom]]] = defaultdict(list)
        self.flags: dict[str, Column] = {}

    def add(self, control: int, covers: bool, atom: Atom) -> None:
        """An atom that must hold for a row to be covered, or else to comply."""
        self.atoms[atom.kind, atom.column].append((covers, control, atom))

    def flag(self, condition: Column) -> Atom:
        """An atom for a condition that Spark computes."""
        name = f"_flag_{len(self.flags)}"
        self.flags[name] = F.coalesce(condition, F.lit(False)).cast("bigint")
        return Atom("flag", name, "eq", (1,))

    def columns(self) -> list[Column]:
        """What the counting reads of a row, one column per key of ``atoms``."""
        read = {
            "whole": lambda c: quoted(c).cast("bigint"), "real": lambda c: quoted(c).cast("double"), "time": lambda c: quoted(c).cast("timestamp_ntz"),
            "text": quoted, "folded": lambda c: folded(quoted(c)), "flag": lambda c: self.flags[c],
        }
        return [read[kind](column).alias(f"_k{i}") for i, (kind, column) in enumerate(self.atoms)]

    def tables(self) -> list[tuple[str, list, np.ndarray | None, np.ndarray | None]]:
        """Per key: its kind, sorted constants, and the bit strings of its cells for covering and complying."""
        out = []
        for (kind, _), found in self.atoms.items():
            bounds = sorted({v for _, _, atom in found for v in atom.values})
            place = {v: k for k, v in enumerate(bounds)}
            cells = 2 * len(bounds) + 2
            strings: list[np.ndarray | None] = [None, None]
            for covers, control, atom in found:
                which = 0 if covers else 1
                if strings[which] is None:
                    strings[which] = np.ones((cells, self.controls), bool)
                strings[which][:, control] &= _holds(atom, place, cells)
            out.append((kind, bounds, *(None if s is None else np.packbits(s, axis=1) for s in strings)))
        return out

    def counts(self, frame: DataFrame) -> DataFrame:
        """(``control``, ``covered``, ``broken``): rows that each control covers, and those of them that don't comply.

        One pass without a shuffle but for one row per control and task.
        """
        tables, controls, at_once = self.tables(), self.controls, max(1, BITS_AT_ONCE // self.controls)

        def cells_of(column, kind: str, bounds: list):
            none = 2 * len(bounds) + 1
            if kind in ("text", "folded"):
                place = {v: 2 * k + 1 for k, v in enumerate(bounds)}
                coded = column.dictionary_encode()
                of_code = np.array([*(place.get(v, 0) for v in coded.dictionary.to_pylist()), none], np.int64)
                return of_code[coded.indices.fill_null(len(of_code) - 1).to_numpy(zero_copy_only=False)]
            if kind == "time":
                column = column.cast(pa.timestamp("us")).cast(pa.int64())
            values = column.fill_null(0).to_numpy(zero_copy_only=False)
            sought = np.array(bounds, np.float64 if kind == "real" else np.int64)
            # absent numbers sort behind all others, as in Spark
            cells = np.searchsorted(sought, values, "left") + np.searchsorted(sought, values, "right")
            return np.where(column.is_null().to_numpy(zero_copy_only=False), none, cells)

        def count(batches):
            covered, broken = np.zeros(controls, np.int64), np.zeros(controls, np.int64)
            every = np.packbits(np.ones((1, controls), bool), axis=1)
            for part in batches:
                cells = [cells_of(part.column(i), kind, bounds) for i, (kind, bounds, _, _) in enumerate(tables)]
                for start in range(0, part.num_rows, at_once):
                    stop = min(start + at_once, part.num_rows)
                    found = [np.repeat(every, stop - start, axis=0), np.repeat(every, stop - start, axis=0)]
                    for own, (_, _, *strings) in zip(cells, tables, strict=True):
                        for which in (0, 1):
                            if strings[which] is not None:
                                found[which] &= strings[which][own[start:stop]]
                    covered += np.unpackbits(found[0], axis=1, count=controls).sum(axis=0, dtype=np.int64)
                    broken += np.unpackbits(found[0] & ~found[1], axis=1, count=controls).sum(axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"control": np.arange(controls, dtype=np.int32), "covered": covered, "broken": broken})

        columns = self.columns() or [F.lit(1).alias("_k")]
        per_task = frame.select(*columns).mapInArrow(count, "control int, covered bigint, broken bigint")
        return per_task.groupBy("control").agg(F.sum("covered").alias("covered"), F.sum("broken").alias("broken"))


# --- what the scan may leave out ------------------------------------------------------


def _ranges(atoms: list[Atom]) -> list[tuple] | None:
    """Closed ranges that hold every value for which all these atoms are true; None if any value may be."""
    out: list[tuple] | None = None
    for atom in atoms:
        v = atom.values[0] if atom.values else None
        own = {
            "eq": lambda: [(v, v)], "in": lambda: [(x, x) for x in sorted(set(atom.values))],
            "lt": lambda: [(None, v)], "lte": lambda: [(None, v)], "gt": lambda: [(v, None)], "gte": lambda: [(v, None)],
        }.get(atom.op, lambda: None)()
        if own is None:
            continue
        out = own if out is None else [both for a in out for b in own if (both := _both(a, b)) is not None]
    return out


def _both(a: tuple, b: tuple) -> tuple | None:
    low = max((x for x in (a[0], b[0]) if x is not None), default=None)
    high = min((x for x in (a[1], b[1]) if x is not None), default=None)
    return None if low is not None and high is not None and low > high else (low, high)


def _merged(ranges: list[tuple], limit: int) -> list[tuple]:
    """The union of ranges, with the smallest gaps closed until at most ``limit`` are left."""
    out: list[list] = []
    for low, high in sorted(ranges, key=lambda r: (r[0] is not None, r[0])):
        if out and (out[-1][1] is None or low is None or low <= out[-1][1]):
            if out[-1][1] is not None:
                out[-1][1] = None if high is None else max(high, out[-1][1])
        else:
            out.append([low, high])
    gaps = sorted(range(1, len(out)), key=lambda i: out[i - 1][1] - out[i][0])
    open_gaps = set(gaps[: limit - 1])
    final: list[list] = []
    for i, r in enumerate(out):
        if final and i not in open_gaps:
            final[-1][1] = r[1]
        else:
            final.append(list(r))
    return [tuple(r) for r in final]


def covering(filter_sets: Iterable[tuple], lineage: Lineage) -> Column | None:
    """A condition on single columns that holds for every row that any of the filter sets keeps.

    For each column that all sets bind, the union of their ranges or texts, so that the scan can skip
    files and row groups however many controls there are. None if there is no such column.
    """
    bound: list[dict[tuple, list[Atom]]] = []
    for actions in filter_sets:
        own: dict[tuple, list[Atom]] = defaultdict(list)
        for atom in (atom_of(a, lineage) for a in actions):
            if atom is not None:
                own[atom.kind, atom.column].append(atom)
        bound.append(own)
    if not bound:
        return None
    conditions = []
    for kind, name in sorted(set.intersection(*(set(b) for b in bound))):
        found = [_ranges(b[kind, name]) for b in bound]
        if any(r is None for r in found):
            continue
        ranges, column = [r for own in found for r in own], quoted(name)
        if kind == "text":
            texts = sorted({low for low, _ in ranges})
            if len(texts) <= TEXTS:
                conditions.append(column.isin(*texts) if texts else F.lit(False))
            continue
        typed = (lambda v, t=lineage.types[name]: literal(EPOCH + timedelta(microseconds=v), t)) if kind == "time" else F.lit
        merged = _merged(ranges, RANGES)
        if (None, None) not in merged:
            above = lambda low: [] if low is None else [column >= typed(low)]
            below = lambda high: [] if high is None else [column <= typed(high)]
            conditions.append(any_of(all_of(above(low) + below(high)) for low, high in merged))
    return all_of(conditions) if conditions else None
