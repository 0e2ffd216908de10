"""Python functions as column functions that hold little: of an Arrow batch, a slice of about SLICE bytes is in Python at a
time, and what is made of it goes back to Arrow before the next. A worker's memory follows the slice, not the table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE = 1 << 20


def cuts(columns: tuple[pa.Array, ...]) -> list[tuple[int, int]]:
    """(start, rows) of slices of about SLICE bytes of text; a row is never cut."""
    n = len(columns[0])
    size = np.full(n, 64, dtype=np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.diff((np.cumsum(size) - size) // SLICE, prepend=-1)) if n else np.array([], dtype=np.int64)
    return [(int(a), int(b - a)) for a, b in zip(first, [*first[1:], n])]


def sliced(kind: T.DataType):
    """A decorator: a function of a row's values (None for null) as a column function of the given type."""

    def make(f):
        made = to_arrow_type(kind)

        def of(*parts: pa.Array) -> pa.Array:
            return pa.array([f(*row) for row in zip(*(p.to_pylist() for p in parts))], type=made)

        @F.arrow_udf(kind)
        def apply(*columns: pa.Array) -> pa.Array:
            out = [of(*(c.slice(start, n) for c in columns)) for start, n in cuts(columns)]
            return pa.concat_arrays(out) if out else pa.array([], type=made)

        return apply

    return make
