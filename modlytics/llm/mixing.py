"""Mixing sources to target weights, with built-in expressions only.

Each document gets a hash-random key. Documents are sorted by range on source and key, so a hot source
is spread over many ranges and small sources share one. Sums of a source's ranges give each its start
in the source; in the one range where the source's budget runs out, running sums give the document at
which it does, the source's cut. Whole repeats of a source come before the cut. Sources are ordered in
the same way, so their number has no bound either: what one task sums up alone is a row per range.

Defined cases: a null text has no words; null is a source of its own, after all others; documents
alike in id and size share what falls to them at the cut evenly; an empty table gives no rows; with
no words at all every target is 0. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlytics.llm.common import WORD, packed, stored, whole_text

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST_REPEATS = 2.0
SEED = "mix-1"
SOURCE = ["no_source", "source"]


def mix_key(doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), doc_id.cast("string")).cast("binary"))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, no_source, size, key), one narrow row per document."""
    return docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("source").isNull().alias("no_source"),
        n_words(whole_text()).alias("size"),
        mix_key(F.col("doc_id")).alias("key"),
    )


def ranged(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows in ranges of the order, with the number of their range (part), written once."""
    return stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def running_sums(rows: DataFrame, order: list[str], values: list[str], name: str) -> DataFrame:
    """The rows with ``<value>_to``, the sum up to and with a row, and ``<value>_all``, the sum of all.

    The order names each row uniquely. A range is summed in its own task; the sums of ranges, as many as
    shuffle partitions, are added up in one.
    """
    placed = ranged(rows, order, name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part").agg(*[F.sum(v).alias(v) for v in values])
    starts = sums.select(
        "part",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_start") for v in values],
        *[F.sum(v).over(Window.partitionBy()).alias(f"{v}_all") for v in values],
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(v).over(inside).alias(f"{v}_in") for v in values]).join(starts, "part")
    sums_to = [(F.col(f"{v}_start") + F.col(f"{v}_in")).alias(f"{v}_to") for v in values]
    return summed.select(*rows.columns, *sums_to, *[f"{v}_all" for v in values])


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, no_source, source_size, target), one row per source.

    Sources in order of code points, null last, have the weights in turn. A target is the smaller of
    twice the source and ``level * weight``: sorted by how soon the source is used up, ``level`` is
    what is left to share over the weights left, at the first source that this doesn't use up. That
    one number passes through the driver.
    """
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    counted = sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    named = running_sums(counted, SOURCE, ["one"], "sources-by-name").select(
        *SOURCE,
        "source_size",
        F.get(weights, ((F.col("one_to") - 1) % len(WEIGHTS)).cast("int")).alias("weight"),
        (F.col("source_size") * MOST_REPEATS).alias("most"),
    )
    ending = named.withColumn("end", F.col("most") / F.col("weight"))
    by_end = ["end", *SOURCE]
    summed = running_sums(ending, by_end, ["source_size", "most", "weight"], "sources-by-end")
    left = F.col("source_size_all") * BUDGET - (F.col("most_to") - F.col("most"))
    levels = summed.withColumn("level", left / (F.col("weight_all") - F.col("weight_to") + F.col("weight")))
    first = levels.filter("level <= end").agg(F.min(F.struct(*by_end, "level"))["level"].alias("level")).first()
    return summed.select(*SOURCE, "source_size", F.least("most", F.lit(first["level"]).cast("double") * F.col("weight")).alias("target"))


def source_cuts(sized: DataFrame) -> DataFrame:
    """source_targets with (repeats, cut, cut_words): all documents are taken ``repeats`` times, those
    before ``cut`` once more, and of those at the cut ``cut_words`` words each."""
    # F.sum over a null-free integer column of a source without words is 0, and 0 words are taken of it.
    whole = F.floor("target")
    budgets = source_targets(sized).withColumn(
        "repeats", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    )
    budgets = budgets.withColumn("rest", whole - F.col("repeats") * F.col("source_size"))
    # Documents alike in place are in one range, as all that tells them apart is in the order.
    placed = ranged(sized, [*SOURCE, "key", "doc_id", "size"], "ranges")
    before = Window.partitionBy(*SOURCE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*SOURCE, "part").agg(F.sum("size").alias("words"))
    starts = starts.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    # A rest is less than its source, so it ends in exactly one range.
    ending = starts.join(budgets.select(*SOURCE, "rest"), SOURCE).filter("start < rest and rest <= start + words")
    # The frame is by value: documents alike in place have the same end.
    inside = Window.partitionBy(*SOURCE, "part").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        placed.join(ending.select(*SOURCE, "part", "start", "rest"), [*SOURCE, "part"])
        .withColumn("place", F.struct("key", "doc_id", "size"))
        .withColumn("end", F.col("start") + F.sum("size").over(inside))
    )
    reached = F.col("end") >= F.col("rest")
    cuts = ends.groupBy(*SOURCE).agg(
        F.min(F.when(reached, F.struct("place", "end"))).alias("at"),
        F.coalesce(F.max(F.when(~reached, F.col("end"))), F.min("start")).alias("before"),
    )
    alike = (F.col("at.end") - F.col("before")) / F.col("at.place.size")
    return budgets.join(cuts, SOURCE, "left").select(
        *SOURCE,
        "source_size",
        "target",
        "repeats",
        F.col("at.place").alias("cut"),
        F.floor((F.col("rest") - F.col("before")) / alike).alias("cut_words"),
    )


def _once_more(place: Column) -> tuple[Column, Column]:
    return F.coalesce(place < F.col("cut"), F.lit(False)), F.coalesce(place == F.col("cut"), F.lit(False))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per document."""
    sized = stored(sizes(docs), "sizes")
    cuts = stored(source_cuts(sized), "cuts")
    more, at_cut = _once_more(F.struct("key", "doc_id", "size"))
    part = F.when(more, F.col("size")).when(at_cut, F.col("cut_words")).otherwise(0)
    return sized.join(cuts, SOURCE).select(
        "doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size") + part).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as whole documents, each as many times as it is taken; no text crosses the network.

    The documents at a source's cut are taken once more if at least half of each lies before it.
    """
    cuts = stored(source_cuts(stored(sizes(docs), "sizes")), "cuts")
    rows = packed(docs).select(
        "row",
        F.coalesce("row.source", F.lit("")).alias("source"),
        F.col("row.source").isNull().alias("no_source"),
        F.col("row.doc_id").alias("doc_id"),
        n_words(F.coalesce("row.text", F.lit(""))).alias("size"),
        mix_key(F.col("row.doc_id")).alias("key"),
    )
    more, at_cut = _once_more(F.struct("key", "doc_id", "size"))
    extra = F.when(more | (at_cut & (2 * F.col("cut_words") >= F.col("size"))), 1).otherwise(0)
    copies = (F.col("repeats") + extra).cast("int")
    taken = rows.join(cuts, SOURCE).select("row", F.explode(F.array_repeat(F.lit(0), copies)))
    return taken.select("row.*")
