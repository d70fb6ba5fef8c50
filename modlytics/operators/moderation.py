"""Raw comments -> labelled comments by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.functions import dictionary as fixed
from modlytics.functions.automaton import Version
from modlytics.functions.automaton import deciding_hits as version_hits
from modlytics.functions.rules import deciding_hits, trigger_text, verdict

LABEL_COLUMNS = ["classification", "severity_score", "triggers", "flagged_words"]


def normalise(comments: DataFrame) -> DataFrame:
    """Missing authors, texts and timestamps get their defaults."""
    return comments.withColumns(
        {
            "author": F.coalesce("author", F.lit(fixed.ANONYMOUS)),
            "text": F.coalesce("text", F.lit("")),
            "timestamp": F.coalesce("timestamp", F.lit("")),
        }
    )


def moderate(comments: DataFrame, given: Column | None = None, version: Version | None = None) -> DataFrame:
    """Class, severity, triggers and trigger string of each comment; a null text counts as empty. With a ``version`` of the term
    lists, its entries are looked for in place of those of the rules.

    Row by row, without a shuffle, also on a stream. ``given`` is a struct of classification,
    severity_score and triggers that goes before the rules where it is not null; the rules then read
    nothing of the text.

    The labels come out of ``inline``. Filters on them then stay above it, where a plain projection
    would have the optimizer copy the search into the filter and run it again.
    """
    text = F.coalesce("text", F.lit(""))
    searched = text if given is None else F.when(given.isNull(), text).otherwise("")
    hits_of = deciding_hits if version is None else version_hits(version)
    found = comments.withColumn("_found", hits_of(F.lower(searched)))
    by_rules = verdict(text, F.col("_found"))
    label = by_rules if given is None else F.coalesce(given, by_rules)
    return (
        found.select("*", F.inline(F.array(label)))
        .drop("_found")
        .withColumn("flagged_words", trigger_text(F.col("triggers")))
    )
