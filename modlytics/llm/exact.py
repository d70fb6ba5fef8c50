"""Exact dedup with a heavy-hitter split.

Texts are equal when their digests after removing white space are. Digests that many rows share are
found by Misra-Gries summaries, counted exactly, and their winners are broadcast, so their rows are
settled where they are read. All other digests go through an ordinary shuffle, in which no digest
can have more than ``1 / HEAVY_SHARE`` of all rows.

Defined cases: a null text counts as empty, and all empty texts are one group. Of equal texts the one
with the most code points stays, then the smallest doc_id (null last), then one of the rows that are
alike in both. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import SPACE, packed, stored, unpacked, whole_text

#: A digest is heavy when at least one row in so many has it. There are at most so many of them.
HEAVY_ONE_IN = 1024
#: Counters of a summary; its counts are too low by less than one row in so many.
COUNTERS = 4 * HEAVY_ONE_IN


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, chars, tag), one narrow row per document. The tag tells repeated rows apart."""
    text = whole_text()
    narrow = docs.select("doc_id", digest(text).alias("digest"), F.char_length(text).alias("chars"))
    return stored(narrow.withColumn("tag", F.monotonically_increasing_id()), "signatures")


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The Misra-Gries summary of a task's digests. The row without a digest holds how many rows were
    read, and by how much each count may be too low."""
    counts: dict[bytes, int] = {}
    rows = lost = 0
    for batch in batches:
        rows += len(batch)
        for key, n in batch["digest"].value_counts().items():
            counts[key] = counts.get(key, 0) + int(n)
        if len(counts) > COUNTERS:
            cut = sorted(counts.values(), reverse=True)[COUNTERS]
            lost += cut
            counts = {key: n - cut for key, n in counts.items() if n > cut}
    yield pd.DataFrame({"digest": [None, *counts], "n": [rows, *counts.values()], "lost": [lost] + [0] * len(counts)})


def heavy_digests(signed: DataFrame) -> DataFrame:
    """(digest, ...) of every digest that has at least one row in HEAVY_ONE_IN, counted exactly."""
    summaries = stored(signed.select("digest").mapInPandas(_summarise, "digest binary, n long, lost long"), "summaries")
    total = summaries.agg(
        F.coalesce(F.sum(F.when(F.col("digest").isNull(), F.col("n"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"),
    ).first()
    least = total["rows"] / HEAVY_ONE_IN
    # Counts are at most ``lost`` too low in sum, and that is under a quarter of ``least``: of the digests
    # found here there are fewer than two for each heavy one that there could be.
    found = (
        summaries.filter(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") + F.lit(total["lost"]) >= F.lit(least))
        .select("digest")
    )
    return _groups(signed.join(F.broadcast(found), "digest")).filter(F.col("group_size") >= F.lit(least))


def _groups(signed: DataFrame) -> DataFrame:
    """(digest, group_size, keep): keep is the row that stays, by its place in the order of rows."""
    place = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
    return signed.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(place).alias("keep"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document, dropped ones too."""
    signed = signatures(docs)
    winners = stored(heavy_digests(signed), "heavy")
    heavy = signed.join(F.broadcast(winners), "digest")
    rest = signed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return heavy.unionByName(rest.join(_groups(rest), "digest")).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("tag") == F.col("keep.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents without the copies, with all their columns.

    Whole rows cross the network once, to meet the narrow decisions by document, never by text.
    """
    kept = exact_groups(docs).filter("kept").select(_key(F.col("doc_id")), F.unhex("text_sha256").alias("digest"))
    text = F.coalesce("row.text", F.lit(""))
    rows = packed(docs).select(
        "row", _key(F.col("row.doc_id")), digest(text).alias("digest"), F.char_length(text).alias("chars")
    )
    met = rows.join(kept, ["key", "digest"], "left_semi")
    # Only repeated rows of one document are more than one here.
    return unpacked(met.groupBy("key", "digest").agg(F.max_by("row", "chars").alias("row")))


def _key(doc_id: Column) -> Column:
    """A key that is never null; no id is an empty string."""
    return F.coalesce(doc_id.cast("string"), F.lit("")).alias("key")
