"""Small builders for the tests."""

import contextlib
import io

from controlweave.sources.catalog import Catalog
from controlweave.workload.common import (  # noqa: F401
    computed,
    control,
    join,
    keep,
    keep_in,
    keep_null,
    match,
    rule,
)


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def catalog(**frames):
    return Catalog(frames)


def values(df, *columns):
    """Rows as sorted tuples."""
    rows = [tuple(row[c] for c in (columns or df.columns)) for row in df.collect()]
    return sorted(rows, key=lambda row: tuple((v is not None, str(v)) for v in row))


def plan(df, mode="formatted"):
    """The physical plan as text."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()
