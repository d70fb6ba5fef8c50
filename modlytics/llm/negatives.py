"""Hard negatives by rotated one-bit codes.

A vector x is turned by a fixed orthogonal matrix; its code is the sign s of each component. With s scaled to
length one, x = <x, s> s + r, where r is at a right angle to s. The index stores the code, the alignment <x, s> and
the length of r. For an anchor q, <q, x> = <x, s> <q, s> + <q, r>, and by Cauchy-Schwarz the last term is at most
|q - <q, s> s| |r|. <q, s> is counted by popcounts of the code against the bit planes of q's components in PLANES
bits; what that rounds away is bounded in the same way. So each pair has an interval that is certain to hold
its score. Only pairs whose interval may reach the result are scored, in integers.

Two passes: an anchor's positives are the best rows of its label; its negatives the best rows of other labels
whose score is at most a positive's and at least 80 percent of it. In both, a row is left out of a block only if so
many others of the block are certain to go before it, or if its interval lies outside of the wanted scores:
the result is exact.

All anchors meet all rows in blocks: rows are sorted by label and cut into blocks of at most some BLOCK_ROWS; an
anchor goes to the blocks of its label in the first pass and to all in the second. A block's rows are held by
one task, anchors stream past. A label with a third of all rows is many blocks.

Defined cases: rows with a null id, label or vector, a null, infinite or undefined component, or another number
of components than most vectors have take no part; a zero vector does; repeated rows are rows of their own, but never
positives or negatives of an anchor with their id; an anchor's id that occurs more than once is an anchor once, by
the least label and then the least vector; fewer rows than wanted give fewer; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlytics.llm.common import stored
from modlytics.llm.vectors import finite, met, shape, unpacked

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least so many percent of the positive's.
LEAST_PERCENT = 80
ANCHOR_EVERY = 100
RELABEL_EVERY, LABELS = 7, 10

SEED = 11
PLANES = 8
BLOCK_ROWS = 1 << 18
#: Blocks are not made smaller than this only to have more of them.
LEAST_BLOCK = 1 << 11
#: Scores beyond a long stay at its bounds.
LARGEST = (1 << 63) - 1
#: Pairs that are worked through at once, and components of the vectors that are scored at once.
PAIRS = 1 << 18
COMPONENTS = 1 << 20


def _rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))[0]


def _padded_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words; the last word is filled up with zeros."""
    n, dim = bits.shape
    padded = np.zeros((n, -(-dim // 64) * 64), bool)
    padded[:, :dim] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def encoded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, lengths of the rest) of integer vectors."""
    turned = vectors.astype(np.float64) @ _rotation(vectors.shape[1]).T
    align = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    rest = np.sqrt(np.maximum(0.0, (turned**2).sum(axis=1) - align**2))
    return _padded_words(turned >= 0), align, rest


class Planes:
    """Anchors in bit planes, ready to be counted against codes."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.dim = vectors.shape[1]
        turned = vectors.astype(np.float64) @ _rotation(self.dim).T
        self.least = turned.min(axis=1)
        span = turned.max(axis=1) - self.least
        self.step = np.where(span > 0, span / ((1 << PLANES) - 1), 1.0)
        levels = np.rint((turned - self.least[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = [_padded_words((levels >> k) & 1 == 1) for k in range(PLANES)]
        self.levels = levels.sum(axis=1)
        rounded = self.least[:, None] + self.step[:, None] * levels
        self.lost = np.linalg.norm(turned - rounded, axis=1)
        self.length = np.linalg.norm(turned, axis=1)

    def intervals(self, codes: np.ndarray, align: np.ndarray, rest: np.ndarray, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each anchor of ``some`` with each row."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        counted = np.zeros((len(self.least[some]), len(codes)), np.int64)
        for k, plane in enumerate(self.planes):
            for word in range(codes.shape[1]):
                held = np.bitwise_count(plane[some, word, None] & codes[None, :, word])
                counted += held.astype(np.int64) << k
        least, step, lost, length = (x[some, None] for x in (self.least, self.step, self.lost, self.length))
        on_code = least * (2 * ones - self.dim) + step * (2 * counted - self.levels[some, None])
        on_code /= np.sqrt(self.dim)
        off_code = np.sqrt(np.maximum(0.0, length**2 - np.maximum(0.0, np.abs(on_code) - lost) ** 2))
        # The last term is for what floating-point numbers round away.
        width = align * lost + off_code * rest + 1e-6 + 1e-9 * length * (align + rest)
        middle = on_code * align
        return middle - width, middle + width


def _scores(a: np.ndarray, who: np.ndarray, b: np.ndarray, what: np.ndarray) -> np.ndarray:
    """Inner products of rows ``who`` of a with rows ``what`` of b, a bounded number of components at once."""
    at_once = max(1, COMPONENTS // a.shape[1])
    return np.concatenate(
        [_score(a[who[i : i + at_once]], b[what[i : i + at_once]]) for i in range(0, len(who), at_once)] or [np.zeros(0, np.int64)]
    )


def _score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integer vectors."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", a, b)
    exact = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)]
    return np.array([max(-LARGEST, min(LARGEST, score)) for score in exact], np.int64)


def _nth_greatest(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th greatest of each row, minus infinity where there are not so many."""
    if values.shape[1] < n:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - n, axis=1)[:, values.shape[1] - n]


def _best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the n best of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, groups))
    held = groups[order]
    first = np.flatnonzero(np.diff(held, prepend=-1))
    place = np.arange(len(held)) - np.repeat(first, np.diff(np.append(first, len(held))))
    return order[place < n]


def _narrow(vector: np.ndarray) -> bytes:
    """A vector in two bytes a component where these are enough, else in eight."""
    return vector.astype("<i2" if np.abs(vector).max() < 1 << 15 else "<i8").tobytes()


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    packed = column.to_pylist()
    if all(len(v) == 2 * dim for v in packed):
        return np.frombuffer(b"".join(packed), "<i2").reshape(-1, dim)
    return np.stack([np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<i8").astype(np.int64) for v in packed])


class Block:
    """The rows of a block as arrays."""

    def __init__(self, table: pa.Table, dim: int) -> None:
        columns = table.combine_chunks()
        self.ids = columns["vec_id"].to_numpy()
        self.labels = columns["label"].to_numpy()
        self.vectors = _integers(columns["vec"].chunk(0), dim)
        self.codes = unpacked(columns["code"].chunk(0), "<u8")
        self.align = columns["align"].to_numpy()
        self.rest = columns["rest"].to_numpy()

    def chunks(self, anchors: "Block") -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Some anchors at a time, with the intervals of their scores."""
        planes = Planes(anchors.vectors)
        some = max(1, PAIRS // len(self.ids))
        for a in range(0, len(anchors.ids), some):
            here = slice(a, min(a + some, len(anchors.ids)))
            yield here, *planes.intervals(self.codes, self.align, self.rest, here)


def _positives(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    anchors = Block(pa.Table.from_batches([batch]), block.vectors.shape[1])
    for some, low, high in block.chunks(anchors):
        wanted = (block.labels == anchors.labels[some, None]) & (block.ids != anchors.ids[some, None])
        bar = _nth_greatest(np.where(wanted, low, -np.inf), POSITIVES)
        who, what = np.nonzero(wanted & (high >= bar[:, None]))
        scores = _scores(anchors.vectors[some], who, block.vectors, what)
        best = _best(who, scores, block.ids[what], POSITIVES)
        columns = [anchors.ids[some][who[best]], block.ids[what[best]], scores[best]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "positive_id", "positive_score"])


def _negatives(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    anchors = Block(pa.Table.from_batches([batch]), block.vectors.shape[1])
    listed = batch.column("bounds").to_pylist()
    for some, low, high in block.chunks(anchors):
        other = (block.labels != anchors.labels[some, None]) & (block.ids != anchors.ids[some, None])
        bounds = [listed[i] for i in range(some.start, some.stop)]
        reach = np.zeros(other.shape, bool)
        for k in range(max(map(len, bounds))):
            most = np.array([b[k] if k < len(b) else np.nan for b in bounds], float)[:, None]
            least = most * (LEAST_PERCENT / 100)
            sure = other & (low >= least) & (high <= most)
            bar = np.fmax(least[:, 0], _nth_greatest(np.where(sure, low, -np.inf), NEGATIVES))
            # A negative positive score has no scores between it and a share of it.
            reach |= other & (low <= most) & (high >= bar[:, None] - 1e-6 * np.abs(bar[:, None])) & (most >= 0)
        who, what = np.nonzero(reach)
        scores = _scores(anchors.vectors[some], who, block.vectors, what)
        for k in range(max(map(len, bounds))):
            known = np.array([k < len(b) for b in bounds])
            most = np.array([b[k] if k < len(b) else 0 for b in bounds], np.int64)
            inside = np.flatnonzero(known[who] & (scores <= most[who]) & (100 * scores >= LEAST_PERCENT * most[who]))
            best = inside[_best(who[inside], scores[inside], block.ids[what[inside]], NEGATIVES)]
            columns = [anchors.ids[some][who[best]], most[who[best]], block.ids[what[best]], scores[best]]
            names = ["anchor_id", "positive_score", "negative_id", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def vectors_of(table: DataFrame) -> DataFrame:
    """embeddings -> (vec_id, label, vector): labels as the task has them, components as integers."""
    usable = table.select("vec_id", "label", "embedding").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")))
    return usable.select("vec_id", label.cast("long").alias("label"), vector.alias("vector"))


_FIELDS = ["label", "vec", "code", "align", "rest"]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            vectors = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            codes, align, rest = encoded(vectors)
            packed = [pa.array([_narrow(v) for v in vectors], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *packed, pa.array(align), pa.array(rest)], ["vec_id", "anchor", *_FIELDS]
            )


def indexed(vectors: DataFrame, is_anchor: Column, rows: int) -> DataFrame:
    """(vec_id, anchor, label, vec, code, align, rest, block): rows sorted by label, cut into blocks, written once."""
    spark = vectors.sparkSession
    blocks = max(1, -(-rows // BLOCK_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-rows // LEAST_BLOCK)))
    marked = vectors.select("vec_id", F.coalesce(is_anchor, F.lit(False)).alias("anchor"), "label", "vector")
    schema = "vec_id bigint, anchor boolean, label bigint, vec binary, code binary, align double, rest double"
    ranged = marked.mapInArrow(_index, schema).repartitionByRange(blocks, "label", "vec_id")
    return stored(ranged.withColumn("block", F.spark_partition_id()), "vectors")


def _best_of(table: DataFrame, group: list[str], score: str, name: str, n: int) -> DataFrame:
    """The n best per group with their rank; each task keeps its own n before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), name)
    return table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """(vec_id, label, vector) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    dim, rows = shape(vectors, "vector")
    index = indexed(vectors.filter(F.size("vector") == dim), is_anchor, rows)
    blocks = (index.agg(F.max("block")).first()[0] or 0) + 1
    anchors = index.filter("anchor").groupBy("vec_id").agg(F.min(F.struct(*_FIELDS)).alias("one")).select("vec_id", "one.*")
    anchors = stored(anchors, "anchors")
    held = index.select("block", "vec_id", *_FIELDS)
    prepare = lambda table: Block(table, dim)

    # A label's blocks stand side by side.
    labels = index.groupBy("label").agg(F.sequence(F.min("block"), F.max("block")).alias("blocks"))
    own = anchors.join(labels, "label").select(F.explode("blocks").alias("block"), "vec_id", *_FIELDS)
    found = met(held, own, blocks, prepare, _positives, "anchor_id bigint, positive_id bigint, positive_score bigint")
    positives = stored(_best_of(found, ["anchor_id"], "positive_score", "positive_id", POSITIVES).drop("rank"), "positives")

    bounds = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score")).alias("bounds"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asked = anchors.join(bounds, "vec_id").select(every, "vec_id", *_FIELDS, "bounds")
    schema = "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = met(held, asked, blocks, prepare, _negatives, schema)
    negatives = _best_of(found, ["anchor_id", "positive_score"], "negative_score", "negative_id", NEGATIVES)
    return positives.join(negatives, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
