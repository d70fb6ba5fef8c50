"""Search by an index of trigrams.

Comments are stored in blocks, a partition folder each. The index says which blocks hold which runs of three ASCII characters.
From a pattern follow trigrams that any match must hold; only blocks with all of them are read, and their
comments are verified by the pattern itself, so the result is that of reading everything. A pattern from which nothing
follows reads everything.

Case does not count. Besides the capitals, four letters beyond ASCII match an ASCII one when case doesn't count; these
are indexed as that one, and all others end a run.

Defined cases: a null text matches nothing; no pattern shows all comments; an empty table has no blocks.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions travel with their tasks by value, as executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: About how many comments are in a block, as long as there are no more blocks than this.
BLOCK_ROWS = 2000
MOST_BLOCKS = 100_000
#: Folders of the index, by a hash of the trigram.
BUCKETS = 64
ROWS, INDEX = "rows", "index"
#: A pattern with more alternatives than this reads everything.
MOST_WAYS = 64

#: Letters beyond ASCII that match an ASCII letter, and that letter. Fixed values.
FOLDED = {"K": "k", "ſ": "s", "ı": "i", "İ": "i"}


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, "".join(FOLDED), "".join(FOLDED.values())))


def code_of(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 14 | b << 7 | c


def _codes(text: bytes) -> np.ndarray:
    """Different trigrams of ASCII characters as numbers of 21 bits."""
    letters = np.frombuffer(text, np.uint8).astype(np.int32)
    if len(letters) < 3:
        return np.zeros(0, np.int32)
    codes = letters[:-2] << 14 | letters[1:-1] << 7 | letters[2:]
    plain = letters < 128
    held = np.zeros(1 << 21, bool)
    held[codes[plain[:-2] & plain[1:-1] & plain[2:]]] = True
    return np.flatnonzero(held).astype(np.int32)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, text) -> (block, trigram), each once per block and batch."""
    for batch in batches:
        blocks = np.asarray(batch.column(0))
        for block in np.unique(blocks).tolist():
            texts = batch.column(1).filter(pa.array(blocks == block)).to_pylist()
            found = _codes(b"\xff".join(t for t in texts if t is not None))  # no ASCII, so it ends a run
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block, np.int32)), pa.array(found)], ["block", "trigram"])


def bucket_of(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def write_indexed(comments: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Writes comments by block, then the index of the blocks. Both are spread evenly, whatever creators there are: a block is
    rows that are near each other by creator and time. There are MOST_BLOCKS at most."""
    spark = comments.sparkSession
    count = comments.count()
    if not count:  # no block, but a file that says what the columns are
        comments.write.parquet(f"{path}/{ROWS}/block=0")
        spark.createDataFrame([], "block int, trigram int").write.parquet(f"{path}/{INDEX}/bucket=0")
        return
    blocks = max(1, min(MOST_BLOCKS, -(-count // block_rows)))
    ranged = comments.repartitionByRange(blocks, "profile_url", "timestamp", "comment_id")
    ranged.withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{path}/{ROWS}")
    rows = spark.read.parquet(f"{path}/{ROWS}").select("block", folded(F.col("text")).cast("binary").alias("text"))
    held = rows.mapInArrow(_postings, "block int, trigram int").distinct()
    placed = held.withColumn("bucket", bucket_of(F.col("trigram"))).repartition("bucket")
    placed.sortWithinPartitions("bucket", "trigram").write.partitionBy("bucket").parquet(f"{path}/{INDEX}")


# --- what a pattern needs ---


def _ways(parsed) -> list[list[str]] | None:
    """Alternatives, each a list of texts that a match holds one after another, where neighbours need not touch; None where
    there are too many. A text of one alternative is split by an empty one where something unknown stands between."""
    ways: list[list[str]] = [[""]]
    for kind, value in parsed:
        name = str(kind)
        more: list[list[str]] | None
        if name == "LITERAL":
            letter = FOLDED.get(chr(value), chr(value).lower())
            more = [[letter]] if letter.isascii() else [["", ""]]
        elif name == "SUBPATTERN":
            # A group with flags of its own is not looked into.
            more = _ways(value[3]) if not value[1] and not value[2] else [["", ""]]
        elif name == "BRANCH":
            below = [_ways(branch) for branch in value[1]]
            more = None if any(b is None for b in below) else [way for b in below for way in b]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            once = _ways(value[2])
            more = None if once is None else [[*way, ""] for way in once]
        elif name == "AT":
            more = [[""]]
        else:
            more = [["", ""]]
        if more is None or len(ways) * len(more) > MOST_WAYS:
            return None
        # The last text of one and the first of the other touch.
        ways = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in ways for b in more]
    return ways


def required_trigrams(pattern: str) -> list[frozenset[str]] | None:
    """Sets of trigrams such that any text with a match holds all of at least one of them; None if that can't be said."""
    # Groups that set flags, look around or name something, and quoted parts, are read differently elsewhere.
    if re.search(r"\(\?(?!:)|\\[QEGzZbB0-9]", pattern):
        return None
    try:
        ways = _ways(parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None
    if ways is None:
        return None
    sets = [frozenset(run[i : i + 3] for run in way for i in range(len(run) - 2)) for way in ways]
    return sets if all(sets) else None


def candidate_blocks(spark: SparkSession, path: str, needed: list[frozenset[str]]) -> DataFrame:
    """(block) of the blocks that hold all trigrams of some set. Only the trigrams' folders and row groups are read."""
    wanted = sorted({code_of(g) for way in needed for g in way})
    asked = spark.createDataFrame([(g,) for g in wanted], "trigram int")
    buckets = [r[0] for r in asked.select(bucket_of(F.col("trigram"))).distinct().collect()]
    index = spark.read.parquet(f"{path}/{INDEX}")
    postings = index.filter(F.col("bucket").isin(buckets) & F.col("trigram").isin(wanted))
    held = postings.groupBy("block").agg(F.collect_set("trigram").alias("held"))  # at most as many as are wanted
    ways = [F.forall(F.array(*[F.lit(code_of(g)) for g in sorted(way)]), lambda g: F.array_contains("held", g)) for way in needed]
    some = ways[0]
    for way in ways[1:]:
        some |= way
    return held.filter(some).select("block")


def search_indexed(spark: SparkSession, path: str, term: str = "") -> DataFrame:
    """Comments whose text has a match of the pattern, whatever its case; no term shows all. As views.search, but only blocks
    that can have a match are read; their numbers reach the driver (MOST_BLOCKS at most)."""
    rows = spark.read.parquet(f"{path}/{ROWS}")
    if not term:
        return rows.drop("block")
    needed = required_trigrams(term)
    if needed is not None:
        blocks = [r["block"] for r in candidate_blocks(spark, path, needed).collect()]
        rows = rows.filter(F.col("block").isin(blocks)) if blocks else rows.limit(0)
    return rows.filter(F.regexp_like("text", F.lit(f"(?iu){term}"))).drop("block")
