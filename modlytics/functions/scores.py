"""Safety score, bands and display numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modlytics.functions import dictionary as fixed


def round_tenth(x: Column) -> Column:
    """A non-negative double rounded to one decimal as its exact binary value demands, ties to even.

    20x is needed exactly to see on which side of a tie x lies. 16x and 4x are exact, so their sum
    and its rounding error (both doubles) hold 20x without loss; the error only matters at a tie.
    """
    big, small = x * 16.0, x * 4.0
    total = big + small
    error = small - (total - big)
    below = F.floor(total / 2.0)
    rest = total - below * 2.0
    up = (rest > 1.0) | ((rest == 1.0) & ((error > 0.0) | ((error == 0.0) & (below % 2 == 1))))
    return (below + F.when(up, 1).otherwise(0)) / 10.0


def safety_score(proper: Column, total: Column) -> Column:
    """Share of proper comments in percent, one decimal; a creator without comments is safe."""
    return F.when(total > 0, round_tenth(proper / total * 100.0)).otherwise(F.lit(fixed.EMPTY_SCORE))


def _banded(score: Column, bands: list[tuple]) -> Column:
    *bounded, last = bands
    chain = F.when(score >= bounded[0][0], F.lit(bounded[0][1]))
    for low, value in bounded[1:]:
        chain = chain.when(score >= low, F.lit(value))
    return chain.otherwise(F.lit(last[1]))


def scan_band(score: Column) -> Column:
    return _banded(score, fixed.SCAN_BANDS)


def safety_band(score: Column) -> Column:
    return _banded(score, [(low, band) for low, band, _ in fixed.SAFETY_BANDS])


def safety_text(score: Column) -> Column:
    return _banded(score, [(low, text) for low, _, text in fixed.SAFETY_BANDS])


def severity_percent(severity: Column) -> Column:
    """Whole percent, cut off, not rounded; null where there is nothing to show."""
    percent = (severity * 100).cast("int")
    return F.when(percent > 0, percent)


def chart_order(classification: Column) -> Column:
    """Place of a class in the chart, counted from 0; unknown classes come last."""
    known = F.array(*[F.lit(c) for c in fixed.CHART_ORDER])
    place = F.array_position(known, classification)
    return F.when(place > 0, place - 1).otherwise(fixed.CHART_ORDER_UNKNOWN)
