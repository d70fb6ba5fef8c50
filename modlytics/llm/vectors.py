"""What the operators on vectors share: clean vectors, and queries that meet rows block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In a block, rows come before queries.
ROW, QUERY = 0, 1


def shape(table: DataFrame, column: str) -> tuple[int, int]:
    """The length that most vectors have, of several the greatest, and how many have it; 0 and 0 if there are none."""
    sizes = table.filter(F.size(column) > 0).groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return (most["d"], most["n"]) if most else (0, 0)


def finite(column: str) -> Column:
    """Whether a vector is there and none of its components is null, infinite or no number."""
    x = F.col(column)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return x.isNotNull() & F.coalesce(whole, F.lit(False))


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of vectors of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def met(
    rows: DataFrame,
    queries: DataFrame,
    blocks: int,
    prepare: Callable[[pa.Table], object],
    answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Each block's queries against each block's rows.

    Both tables have (block, ...), block from 0 on below ``blocks``; their other columns are told apart by
    the caller, who gives both the same ones. A block is one task: its rows are held (``prepare`` gets them
    as a table), its queries stream past them batch by batch, however many there are.
    """
    both = rows.withColumn("kind", F.lit(ROW)).unionByName(queries.withColumn("kind", F.lit(QUERY)), allowMissingColumns=True)
    placed = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for batch in batches:
            marks = np.asarray(batch.column("block")).astype(np.int64) * 2 + np.asarray(batch.column("kind"))
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                here, kind = divmod(int(marks[a]), 2)
                part = batch.slice(a, b - a)
                if here != block:
                    block, held, ready = here, [], None
                if kind == ROW:
                    held.append(part)
                elif held:
                    if ready is None:
                        ready = prepare(pa.Table.from_batches(held))
                    yield from answer(ready, part)

    return placed.mapInArrow(run, schema)
