"""Text -> class, severity and triggers.

Tiers are tried from the gravest down, and the first with a hit decides. The search for list entries
is the only part outside the JVM; all that follows from its result is built from Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from modlytics.functions import dictionary as fixed
from modlytics.functions.hits import TermList, first_hits


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def term_hits(lowered: Column, terms: list[str]) -> Column:
    """The list entries contained in a lower-cased text, in list order, duplicates kept."""
    return first_hits(TermList(tuple(terms)))(lowered)["hits"]


def deciding_hits(lowered: Column) -> Column:
    """Place of the first tier with a hit and its hits: harmful, abusive, toxic, spam terms and links, emoji.

    Lower case leaves emoji as they are, so one text serves all tiers.
    """
    search = first_hits(
        TermList(tuple(fixed.HARMFUL_TERMS)),
        TermList(tuple(fixed.ABUSIVE_TERMS)),
        TermList(tuple(fixed.TOXIC_TERMS)),
        TermList(tuple(fixed.SPAM_TERMS), fixed.URL_TAG, fixed.LINK_PATTERN),
        TermList((), fixed.EMOJI_TAG, fixed.EMOJI_FLOOD_PATTERN),
    )
    return search(lowered)


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """Match of a costly pattern, tried only where a cheap one that it implies is found."""
    return F.regexp_like(text, F.lit(hint)) & F.regexp_like(text, F.lit(pattern))


def has_link(lowered: Column) -> Column:
    """Whether the link part of the spam tier has a hit."""
    return first_hits(TermList((), fixed.URL_TAG, fixed.LINK_PATTERN))(lowered)["place"] == 0


def is_yelling(text: Column) -> Column:
    return _matches(text, fixed.YELLING_PATTERN, fixed.YELLING_HINT)


def emoji_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(fixed.EMOJI_PATTERN))


def has_emoji_flood(text: Column) -> Column:
    """Whether the emoji tier has a hit: more emoji than the limit."""
    return first_hits(TermList((), fixed.EMOJI_TAG, fixed.EMOJI_FLOOD_PATTERN))(text)["place"] == 0


def severity(hits: Column, base: int, step: int, cap: int, yelling: Column | None = None, yelling_cap: int = 0) -> Column:
    """Severity from the number of hits. Integer hundredths keep it exact until the last division."""
    hundredths = F.least(F.lit(base) + F.lit(step) * F.size(hits), F.lit(cap))
    if yelling is not None:
        hundredths = F.when(
            yelling, F.least(hundredths + fixed.YELLING_STEP, F.lit(yelling_cap))
        ).otherwise(hundredths)
    return hundredths / F.lit(100.0)


def _verdict(label: str, score: Column, triggers: Column) -> Column:
    return F.struct(
        F.lit(label).alias("classification"),
        score.cast("double").alias("severity_score"),
        triggers.cast("array<string>").alias("triggers"),
    )


def verdict(text: Column, found: Column) -> Column:
    """Struct of classification, severity_score and triggers from a text and its deciding hits.

    Yelling is looked at only in the branches that need it.
    """
    place, hits = found["place"], found["hits"]

    def shouted(label: str, scale: dict[str, int]) -> Column:
        def tagged(loud: Column) -> Column:
            marked = F.when(loud, F.concat(hits, F.array(F.lit(fixed.YELLING_TAG)))).otherwise(hits)
            return _verdict(label, severity(hits, yelling=loud, **scale), marked)

        return bind(is_yelling(text), tagged)

    return (
        F.when(place == 0, _verdict(fixed.HARMFUL, severity(hits, **fixed.HARMFUL_SEVERITY), hits))
        .when(place == 1, shouted(fixed.ABUSIVE, fixed.ABUSIVE_SEVERITY))
        .when(place == 2, shouted(fixed.TOXIC, fixed.TOXIC_SEVERITY))
        .when(place == 3, _verdict(fixed.SPAM, severity(hits, **fixed.SPAM_SEVERITY), hits))
        .when(place == 4, _verdict(fixed.SPAM, F.lit(fixed.EMOJI_SEVERITY) / 100.0, hits))
        .otherwise(_verdict(fixed.PROPER, F.lit(0.0), F.array()))
    )


def trigger_text(triggers: Column) -> Column:
    return F.array_join(triggers, ", ")
