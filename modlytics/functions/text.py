"""Text and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modlytics.functions import dictionary as fixed


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, fixed.TAG_PATTERN, "")


def epoch_text(seconds: Column, otherwise: Column) -> Column:
    """Epoch seconds as timestamp text (session zone UTC); missing or zero gives ``otherwise``."""
    written = F.date_format(F.timestamp_seconds(seconds), fixed.TIMESTAMP_FORMAT)
    return F.when(seconds != 0, written).otherwise(otherwise)


def iso_text(published: Column, otherwise: Column) -> Column:
    """ISO-8601 as timestamp text by dropping its two letters; missing or empty gives ``otherwise``."""
    written = F.replace(F.replace(published, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))
    return F.when(published != "", written).otherwise(otherwise)


def escape_markup(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def split_triggers(flagged: Column) -> Column:
    """A trigger string as an array, without empty parts."""
    parts = F.transform(F.split(flagged, ","), lambda part: F.btrim(part, F.lit(fixed.BLANKS)))
    return F.filter(parts, lambda part: part != "")


def highlight_tokens(flagged: Column) -> Column:
    """Terms of a trigger string, longest first, rule tags left out."""
    tokens = F.filter(split_triggers(flagged), lambda token: ~token.isin(fixed.SYSTEM_TAGS))
    return F.array_sort(tokens, lambda a, b: F.length(b) - F.length(a))


def highlight(
    text: Column, flagged: Column, opening: str = "<mark>", closing: str = "</mark>", escape: bool = False
) -> Column:
    """The text with each trigger marked in turn, whatever its case, so that contained terms nest."""
    start = escape_markup(text) if escape else text
    around = F.lit(f"{opening}$1{closing}")

    def mark(marked: Column, token: Column) -> Column:
        literal = F.regexp_replace(token, r"([^\p{L}\p{N}_\s])", r"\\$1")
        return F.regexp_replace(marked, F.concat(F.lit("(?iu)("), literal, F.lit(")")), around)

    return F.aggregate(F.coalesce(highlight_tokens(flagged), F.array().cast("array<string>")), start, mark)
