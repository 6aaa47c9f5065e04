"""Which physical column a field name of a control means.

Joins keep every left column as it is, rename right keys to
``{step_id}_{key}`` and give a right column whose name is taken a numbered
suffix. A bare name is the leftmost column of that name; a qualified one
(``alias.column`` or ``step_id.column``) is that dataset's own column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from controlweave.functions.conditions import quoted


# Quoted parts of an expression, or a qualified name that is no function.
_QUALIFIED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|\b(?P<of>[A-Za-z_]\w*)\.(?P<own>[A-Za-z_]\w*)\b(?!\s*[.(])""")
_QUOTED_UNIT = re.compile(r"(\b(?:DATEDIFF|DATE_DIFF|TIMESTAMPDIFF)\s*\(\s*)'(\w+)'\s*,", re.I)


@dataclass(frozen=True)
class Lineage:
    types: dict[str, T.DataType]
    qualified: dict[tuple[str, str], str] = field(default_factory=dict)

    @classmethod
    def of(cls, frame: DataFrame, alias: str) -> Lineage:
        types = {f.name: f.dataType for f in frame.schema.fields}
        return cls(types, {(alias.lower(), n.lower()): n for n in types})

    def physical(self, name: str) -> str:
        """The physical column; an unknown name is passed on for Spark to report."""
        by_lower = {n.lower(): n for n in reversed(list(self.types))}
        if name.lower() in by_lower:
            return by_lower[name.lower()]
        qualifier, _, bare = name.rpartition(".")
        if (qualifier.lower(), bare.lower()) in self.qualified:
            return self.qualified[(qualifier.lower(), bare.lower())]
        return by_lower.get(bare.lower(), bare)

    def expression(self, text: str) -> Column:
        """A Spark SQL expression in which ``alias.column`` means that dataset's own column.

        Texts in quotes and other names stay as they are; ``DATEDIFF('day', a, b)`` is read as
        ``DATEDIFF(day, a, b)``.
        """

        def named(found: re.Match) -> str:
            key = (found["of"] or "").lower(), (found["own"] or "").lower()
            return f"`{self.qualified[key]}`" if key in self.qualified else found[0]

        return F.expr(_QUALIFIED.sub(named, _QUOTED_UNIT.sub(r"\1\2,", text)))

    def column(self, name: str) -> Column:
        return quoted(self.physical(name))

    def type_of(self, name: str) -> T.DataType | None:
        return self.types.get(self.physical(name))

    def free_name(self, wanted: str, taken: set[str]) -> str:
        """``wanted``, or ``wanted_1``, ``wanted_2`` … when it is taken."""
        used = {n.lower() for n in self.types} | taken
        name, n = wanted, 0
        while name.lower() in used:
            n += 1
            name = f"{wanted}_{n}"
        return name

    def joined(self, types: dict, right_names: dict, qualifiers: tuple[str, ...]) -> Lineage:
        """Lineage after a join; ``right_names`` maps the right's own names to physical ones."""
        qualified = dict(self.qualified)
        for qualifier in qualifiers:
            for own, physical in right_names.items():
                qualified.setdefault((qualifier.lower(), own.lower()), physical)
        return replace(self, types={**self.types, **types}, qualified=qualified)

    def with_column(self, name: str, data_type: T.DataType) -> Lineage:
        return replace(self, types={**self.types, name: data_type})
