"""Which list entries a text contains.

A hundred terms over whole texts are the cost of the whole job. Spark's own ``contains`` walks a text
once per term, and its regular expressions try the alternatives one by one. Arrow's matcher finds
any of a list in one walk, so texts without a hit, the most, are done after four walks, and single
terms are looked for only in the texts of the list that was hit. Measured on the given documents,
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from modlytics.functions.slices import whole

FOUND = "struct<place: int, hits: array<string>>"


@dataclass(frozen=True)
class TermList:
    """Entries in the order in which they are named. A tag is named last, where its pattern matches."""

    terms: tuple[str, ...]
    tag: str | None = None
    pattern: str | None = None

    def entries(self) -> list[tuple[str, str]]:
        """(name, pattern) of each entry."""
        tags = [] if self.tag is None else [(self.tag, self.pattern)]
        return [(term, re.escape(term)) for term in self.terms] + tags


def first_hits(*lists: TermList) -> Callable[[Column], Column]:
    """An expression of a lower-cased text: place of the first list with a hit, -1 for none, and its hits."""
    entries = [one.entries() for one in lists]
    names = [name for one in entries for name, _ in one]

    # Nested, so that it travels with its lists and executors need nothing but Arrow and numpy.
    def search(texts: pa.Array) -> pa.Array:
        def matches(some: pa.Array, pattern: str) -> np.ndarray:
            return pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)

        texts = pc.fill_null(texts, "")
        place = np.full(len(texts), -1, dtype=np.int32)
        rows, named = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        open_rows, first_name = np.arange(len(texts)), 0
        for number, one in enumerate(entries):
            remaining = texts if len(open_rows) == len(texts) else texts.take(pa.array(open_rows))
            hit = matches(remaining, "|".join(pattern for _, pattern in one))
            owned, hit_texts = open_rows[hit], remaining.filter(pa.array(hit))
            place[owned] = number
            for offset, (_, pattern) in enumerate(one if len(owned) else []):
                having = owned[matches(hit_texts, pattern)]
                rows.append(having)
                named.append(np.full(len(having), first_name + offset))
            open_rows, first_name = open_rows[~hit], first_name + len(one)
        # Entries were gone through in order, so a stable sort by row leaves each row's hits in order.
        all_rows = np.concatenate(rows)
        in_row_order = np.concatenate(named)[np.argsort(all_rows, kind="stable")]
        ends = np.cumsum(np.bincount(all_rows, minlength=len(texts)))
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        hits = pa.ListArray.from_arrays(offsets, pa.array(names, pa.string()).take(pa.array(in_row_order)))
        return pa.StructArray.from_arrays([pa.array(place), hits], ["place", "hits"])

    in_slices = whole(search)

    def searched(texts: pa.Array) -> pa.Array:
        return in_slices(texts)

    return F.arrow_udf(searched, FOUND)
