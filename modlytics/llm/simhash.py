"""SimHash near-dedup: pigeonhole blocks, then verified Hamming distances.

A fingerprint has 64 bits, cut into BLOCKS blocks. Two fingerprints that differ in at most DISTANCE
bits agree in at least ``BLOCKS - DISTANCE`` blocks, so they meet in at least one of the tables that
are keyed by a choice of that many blocks. Copies are one fingerprint before anything is joined.

With seven blocks there are 35 tables with keys of 27 or 28 bits. A corpus of over some 10^10
different fingerprints is better off with eight (70 tables, 32 bits); six (15 tables, 21 bits) are enough
up to some 10^7.

Buckets of up to BUCKET fingerprints are joined on the bucket. The fingerprints of larger ones are not paired at
all: each names the 2,081 points that differ from it in at most two bits. Two fingerprints name a common
point exactly if they differ in at most four, so linking each to the least one of each of its points
loses nothing, and the work grows with the number of fingerprints.

Defined cases: a null text counts as empty; a text of fewer than four words has one shingle, its words;
a text without words has the fingerprint zero, linked like any other; repeated rows come out as often
as they go in; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import packed, stored, unpacked
from modlytics.llm.components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 7
#: Largest bucket that is joined; comparing its pairs is cheaper than naming points up to here.
BUCKET = 4096
#: Hashes whose bits are counted at once, which bounds the memory of a very long text.
SLICE = 1 << 15


def fingerprint(text: str) -> bytes:
    """The fingerprint in eight bytes, the highest bit first."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1]))
    spans = zip(starts.tolist(), (ends[-n:] - 1).tolist(), strict=True)
    hash_of = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([hash_of(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        counts += np.unpackbits(hashes[at : at + SLICE], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = b"".join(fingerprint(text or "") for text in batch.column(1).to_pylist())
        values = pa.array(np.frombuffer(prints, ">i8").astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), one row per document; fp is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _masks() -> list[int]:
    """One mask per table: the bits of the blocks that its key holds."""
    edges = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(blocks, BLOCKS - DISTANCE)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def _points() -> list[int]:
    """What to flip in a fingerprint to get every point that differs in at most half of DISTANCE bits."""
    flips = [c for n in range(DISTANCE // 2 + 1) for c in combinations(range(64), n)]
    return [_signed(sum(1 << bit for bit in chosen)) for chosen in flips]


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Different fingerprints (fp) -> links (a, b) that give the same components as all links.

    Every link between two fingerprints that share a bucket of up to ``bucket`` is there; larger
    buckets give each point's star in place of all its pairs.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(_masks())])
    keyed = prints.select("fp", F.explode(tables).alias("table")).select(
        F.col("table.t").alias("t"), F.col("fp").bitwiseAND(F.col("table.mask")).alias("key"), "fp"
    )
    shared = stored(
        keyed.groupBy("t", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("n > 1"),
        "buckets",
    )
    twos = shared.filter("n = 2").select("a", "b")
    members = stored(
        keyed.join(shared.filter("n > 2").select("t", "key", (F.col("n") > bucket).alias("large")), ["t", "key"]), "members"
    )
    x = members.filter("not large").select("t", "key", F.col("fp").alias("a"))
    y = members.filter("not large").select("t", "key", F.col("fp").alias("b"))
    # A pair that meets in several tables is linked in the first of them only.
    xor = F.col("a").bitwiseXOR(F.col("b"))
    first = reduce(lambda rest, m: F.when(xor.bitwiseAND(F.lit(m[1])) == 0, m[0]).otherwise(rest), reversed([*enumerate(_masks())]), F.lit(-1))
    joined = x.join(y, ["t", "key"]).filter((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b")) & (F.col("t") == first))
    flips = F.array(*[F.lit(p) for p in _points()])
    pointed = members.filter("large").select("fp").distinct().select("fp", F.explode(flips).alias("flip"))
    pointed = pointed.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    stars = pointed.join(pointed.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "point")
    pairs = twos.filter(_near(F.col("a"), F.col("b"))).unionByName(joined.select("a", "b"))
    return pairs.unionByName(stars.select("a", F.col("fp").alias("b")).filter("a <> b"))


def near_groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id), one row per document; the id is the smallest doc_id of the component."""
    signed = stored(fingerprints(docs), "fingerprints")
    prints = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints.select("fp"), bucket))
    named = stored(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", "root"), "named")
    # Minima are reduced before they are shuffled, and written, so that the join on the root is one of two
    # plain tables, whose hot roots Spark splits. A fingerprint without links takes no part in it.
    linked = named.filter("root is not null")
    smallest = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    alone = named.filter("root is null").select("fp", F.col("least").alias("component_id"))
    ids = stored(linked.join(smallest, "root").select("fp", "component_id").unionByName(alone), "component-ids")
    return signed.join(ids, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns.

    Rows with the same doc_id are the same document here, and all stay or go.
    """
    kept = near_groups(docs).select(F.col("component_id").alias("doc_id")).distinct()
    rows = packed(docs).withColumn("doc_id", F.col("row.doc_id"))
    return unpacked(rows.join(kept, rows["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi"))
