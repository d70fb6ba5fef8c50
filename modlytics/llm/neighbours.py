"""Approximate nearest neighbours by stable projections and a kd-tree.

Nearness is the largest inner product. With one more component, sqrt(M^2 - |x|^2) for rows (M is the greatest
length) and 0 for queries, it is the least Euclidean distance. PROJECTED Gaussian (2-stable) projections then have
a squared projected distance of the squared distance times a chi-square variable with PROJECTED degrees of
freedom. A query takes its projected neighbours in growing distance and verifies each by its inner product
with the original vector; it stops where the chi-square distribution says that with probability CERTAIN a
vector as near as the worst of the best would have been met before.

The projected vectors are in a kd-tree of two levels. The upper one is fitted on a bounded sample (SAMPLE vectors, at
most MOST_CELLS cells), so it fits into every task; all vectors are dealt out to its cells, and a cell with more
than BLOCK_ROWS vectors is several blocks. A block is one task's rows and has a tree of its own. A query is first
searched in its own cell; the distance found there says, by the same test, which other cells it still has to
visit. How many that are depends on the data: few where vectors lie in clusters, nearly all where they lie evenly.

Equal vectors are one in the index, with the least ids that any query could need, so a vector that a third of all
rows have is neither compared nor sent more than once.

Defined cases: rows with a null id, a vector that is null, zero or has null, infinite or undefined components, or another
number of components than most take no part; rows with one id count once, with the vector of the least digest; fewer
candidates than asked for give fewer rows; ties go to the smaller id; an empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlytics.llm.common import stored
from modlytics.llm.vectors import finite, met, shape, unpacked

NEAREST = 20
QUERY_EVERY = 20

PROJECTED = 16
CERTAIN = 0.95
SEED = 13
SAMPLE = 1 << 14
CELL_ROWS = 1 << 12
MOST_CELLS = 1 << 12
BLOCK_ROWS = 1 << 16
#: Vectors in a leaf of a block's tree.
LEAF = 512


def chi_square(x: float, degrees: int) -> float:
    """The probability that a chi-square variable of an even number of degrees is at most x."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 100.0 * degrees
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


#: The search stops at a squared projected distance of so many squared distances of the worst of the best.
STOP = chi_square_quantile(CERTAIN, PROJECTED)


def projections(vectors: np.ndarray, longest: float | None = None) -> np.ndarray:
    """Projected rows, or projected queries where ``longest`` (M) is not given."""
    matrix = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, PROJECTED))
    projected = vectors @ matrix[:-1]
    if longest is not None:
        last = np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(axis=1)))
        projected += last[:, None] * matrix[-1]
    return projected


def _splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A full kd-tree by levels: node i has the children 2i + 1 and 2i + 2. Each cuts the widest dimension at its median."""
    splits: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for some in level:
            wide = int(np.argmax(np.ptp(some, axis=0))) if len(some) else 0
            cut = float(np.median(some[:, wide])) if len(some) else 0.0
            splits.append((wide, cut))
            below += [some[some[:, wide] < cut], some[some[:, wide] >= cut]]
        level = below
    return splits


class Cells:
    """The upper tree: which cell a point is in, and how far it is from the others."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.depth = max(0, (cells - 1).bit_length())
        splits = _splits(sample, self.depth)
        self.wide = np.array([w for w, _ in splits], np.int64)
        self.cut = np.array([c for _, c in splits], float)
        self.n = 1 << self.depth
        self.low = np.full((self.n, PROJECTED), -np.inf)
        self.high = np.full((self.n, PROJECTED), np.inf)
        for cell in range(self.n):
            node = 0
            for level in range(self.depth):
                right = (cell >> (self.depth - 1 - level)) & 1
                side = self.low if right else self.high
                best = np.maximum if right else np.minimum
                side[cell, self.wide[node]] = best(side[cell, self.wide[node]], self.cut[node])
                node = 2 * node + 1 + right

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.wide[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return node - (self.n - 1)

    def squared_distances(self, point: np.ndarray) -> np.ndarray:
        return _outside(point, self.low, self.high)


def _outside(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point from boxes."""
    off = np.maximum(np.maximum(low - point, point - high), 0.0)
    return np.einsum("ij,ij->i", off, off)


class Block:
    """The vectors of a block in the order of its kd-tree's leaves."""

    def __init__(self, table: pa.Table, kind: str, longest: float, nearest: int) -> None:
        columns = table.combine_chunks()
        vectors = unpacked(columns["vec"].chunk(0), kind).astype(np.float64)
        points = projections(vectors, longest)
        self.longest, self.wanted, self.kind = longest, nearest + 1, kind
        order, bounds, pending = [], [0], [np.arange(len(points))]
        while pending:
            some = pending.pop()
            wide = int(np.argmax(np.ptp(points[some], axis=0)))
            if len(some) <= LEAF:
                order.append(some)
                bounds.append(bounds[-1] + len(some))
            else:
                half = len(some) // 2
                at = np.argpartition(points[some, wide], half)
                pending += [some[at[half:]], some[at[:half]]]
        rows = np.concatenate(order)
        self.vectors, self.points, self.bounds = vectors[rows], points[rows], bounds
        spans = list(zip(bounds, bounds[1:]))
        self.low = np.stack([self.points[a:b].min(axis=0) for a, b in spans])
        self.high = np.stack([self.points[a:b].max(axis=0) for a, b in spans])
        members = columns["members"].chunk(0).take(pa.array(rows))
        self.ids = members.flatten().to_numpy()
        self.of = np.repeat(np.arange(len(rows)), members.value_lengths().to_numpy())
        self.first = np.searchsorted(self.of, np.arange(len(rows) + 1))

    def search(self, query: np.ndarray, point: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best in this block with a score of ``bar`` or more."""
        base = float(query @ query) + self.longest**2
        reach = STOP * max(0.0, base - 2 * bar)
        away = _outside(point, self.low, self.high)
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        for leaf in np.argsort(away, kind="stable").tolist():
            if away[leaf] > reach:
                break
            a, b = self.bounds[leaf], self.bounds[leaf + 1]
            off = self.points[a:b] - point
            near = np.flatnonzero(np.einsum("ij,ij->i", off, off) <= reach) + a
            verified = (self.vectors[a:b] @ query)[near - a] if 2 * len(near) > b - a else self.vectors[near] @ query
            good = verified >= bar
            found, scores = np.concatenate([found, near[good]]), np.concatenate([scores, verified[good]])
            if len(found) > self.wanted:
                worst = np.partition(scores, len(scores) - self.wanted)[len(scores) - self.wanted]
                # Scores that differ by no more than what is rounded away stay together until the end.
                keep = scores >= worst - 1e-12 * base
                found, scores = found[keep], scores[keep]
                if worst > bar:
                    bar = worst - 1e-12 * base
                    reach = STOP * max(0.0, base - 2 * bar)
        exact = (self.vectors[found] * query).sum(axis=1)
        listed = [np.arange(self.first[i], self.first[i + 1]) for i in found.tolist()]
        rows = np.concatenate(listed) if listed else np.zeros(0, np.int64)
        values = np.repeat(exact, [len(x) for x in listed])
        best = np.lexsort((self.ids[rows], -values))[: self.wanted]
        return self.ids[rows[best]], values[best]


def _answer(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    queries = unpacked(batch.column("vec"), block.kind).astype(np.float64)
    points = projections(queries)
    bars = batch.column("bar").to_pylist()
    found = [block.search(q, p, -np.inf if bar is None else bar) for q, p, bar in zip(queries, points, bars, strict=True)]
    places = np.repeat(np.arange(len(found)), [len(ids) for ids, _ in found])
    columns = [batch.column("key").take(pa.array(places)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))]
    yield pa.RecordBatch.from_arrays(columns, ["key", "vec_id", "score"])


def clean_vectors(table: DataFrame) -> tuple[DataFrame, str]:
    """embeddings -> (vec_id, key, vec, length) with a digest as the key, and the kind of a component."""
    usable = table.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & finite("embedding"))
    dim, _ = shape(usable, "embedding")
    usable = usable.filter((F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0))
    kind = "<f4" if "float" in table.schema["embedding"].dataType.simpleString() else "<f8"
    vector = "embedding" if kind == "<f4" else F.col("embedding").cast("array<double>").alias("embedding")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) + np.zeros(1, kind)
                packed = [v.astype(kind).tobytes() for v in vectors]
                keys = [hashlib.blake2b(v, digest_size=16).digest() for v in packed]
                lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
                columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(packed, pa.binary()), pa.array(lengths)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "key", "vec", "length"])

    packed = usable.select(F.col("vec_id").cast("long").alias("vec_id"), vector)
    return packed.mapInArrow(pack, "vec_id bigint, key binary, vec binary, length double"), kind


def _first(table: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; each task keeps its own n before the shuffle."""
    return table.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_at") <= n).drop("_at")


def nearest(table: DataFrame, is_query: Column, wanted: int = NEAREST) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score)."""
    clean, kind = clean_vectors(table)
    clean = stored(clean, "clean-vectors")
    named = stored(clean.groupBy("vec_id").agg(F.min("key").alias("key")), "named-vectors")
    # A query lists at most as many ids of one vector as it wants, and one more that is its own.
    members = _first(named, "key", [F.col("vec_id")], wanted + 1).groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    asked = named.filter(is_query).select("key", F.lit(True).alias("asked")).distinct()
    vectors = clean.groupBy("key").agg(F.first("vec").alias("vec"), F.first("length").alias("length"))
    different = stored(vectors.join(members, "key").join(asked, "key", "left"), "different-vectors")

    total = different.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).first()
    n, longest = total["n"], total["longest"] or 0.0
    # At most SAMPLE vectors reach the driver.
    sample = different.select("key", "vec").orderBy("key").limit(SAMPLE).collect()
    points = projections(np.stack([np.frombuffer(r["vec"], kind) for r in sample]).astype(np.float64), longest) if n else np.zeros((0, PROJECTED))
    cells = Cells(points, max(1, min(MOST_CELLS, -(-n // CELL_ROWS))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = cells.of(projections(unpacked(batch.column("vec"), kind).astype(np.float64), longest))
                yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *batch.columns], ["cell", "key", "vec", "members"])

    placed = different.select("key", "vec", "members").mapInArrow(place, "cell int, key binary, vec binary, members array<bigint>")
    placed = stored(placed, "placed-vectors")
    # One row per cell, MOST_CELLS at most.
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [max(1, -(-sizes.get(c, 0) // BLOCK_ROWS)) for c in range(cells.n)]
    starts = np.concatenate([[0], np.cumsum(parts)])
    of_cell = lambda values: F.get(F.lit([int(v) for v in values]), F.col("cell"))
    block = (of_cell(starts[:-1]) + F.pmod(F.xxhash64("key"), of_cell(parts))).cast("int").alias("block")
    rows = placed.select(block, "key", "vec", "members")

    def visits(others: bool):
        """Queries with the blocks that they visit: those of their own cell, or of others not beyond their reach."""

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                queries = unpacked(batch.column("vec"), kind).astype(np.float64)
                points = projections(queries)
                own, bars = cells.of(points), batch.column("bar").to_pylist()
                visited, places = [], []
                for i, (query, point) in enumerate(zip(queries, points, strict=True)):
                    chosen = [own[i]]
                    if others:
                        squared = float(query @ query) + longest**2 - 2 * (-np.inf if bars[i] is None else bars[i])
                        near = cells.squared_distances(point) <= STOP * max(0.0, squared)
                        near[own[i]] = False
                        chosen = np.flatnonzero(near)
                    for cell in chosen:
                        visited += range(starts[cell], starts[cell + 1])
                    places += [i] * (len(visited) - len(places))
                kept = [c.take(pa.array(places, pa.int64())) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(visited, pa.int32()), *kept], ["block", "key", "vec", "bar"])

        return visit

    schema = "block int, key binary, vec binary, bar double"
    best = [F.desc("score"), F.col("vec_id")]
    prepare = lambda block: Block(block, kind, longest, wanted)

    def search(queries: DataFrame, others: bool) -> DataFrame:
        met_in = queries.select("key", "vec", "bar").mapInArrow(visits(others), schema)
        found = met(rows, met_in, int(starts[-1]), prepare, _answer, "key binary, vec_id bigint, score double")
        return found

    queries = different.filter("asked").select("key", "vec", F.lit(None).cast("double").alias("bar"))
    near = stored(_first(search(queries, False), "key", best, wanted + 1), "near")
    bars = near.groupBy("key").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n"))
    bars = bars.select("key", F.when(F.col("n") > wanted, F.col("score")).alias("bar"))
    further = search(queries.drop("bar").join(bars, "key"), True)
    lists = _first(near.unionByName(further), "key", best, wanted + 1).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found")
    )
    answers = named.filter(is_query).select(F.col("vec_id").alias("query_id"), "key").join(lists, "key")
    own = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    ranked = answers.select("query_id", F.posexplode(F.slice(own, 1, wanted)).alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.minus")).alias("score"))
