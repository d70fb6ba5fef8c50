"""Expressions that go through their batches in small slices.

Spark hands Python batches of up to 10,000 rows or 64 MB. What is made of a batch on the way (lists of strings, texts in
lower case, rows left after a filter) takes several times its size, so it is made of slices of about SLICE_BYTES.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Functions travel with their tasks by value, as executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 20


def cuts(columns: tuple[pa.Array, ...], most: int) -> list[tuple[int, int]]:
    """(start, rows) of slices of text columns, in order: all of a slice but its last row has less than ``most`` bytes."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most, prepend=-1))
    return list(zip(starts.tolist(), np.diff(starts, append=len(sizes)).tolist(), strict=True))


def whole(work: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """A function of arrays that treats each row by itself, done in slices; for results that are small beside the texts."""
    most = SLICE_BYTES

    def all_of(*columns: pa.Array) -> pa.Array:
        return pa.concat_arrays([work(*[c.slice(start, rows) for c in columns]) for start, rows in cuts(columns, most)] or [work(*columns)])

    return all_of


def sliced(work: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """An expression of text columns by a function of arrays that treats each row by itself."""
    most = SLICE_BYTES

    def each(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)  # a single column comes bare
            for start, rows in cuts(columns, most):
                yield work(*[c.slice(start, rows) for c in columns])

    return F.arrow_udf(each, kind)
