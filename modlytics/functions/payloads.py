"""Landed JSON text, taken whole or not at all.

The JSON readers stop at the end of the first value and would pass a payload that goes on after it.
Put between two keys of an object, such a payload breaks the object, and is seen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modlytics.functions.rules import bind

# What became of a landed payload.
OK, EMPTY, BROKEN, TOO_DEEP = "ok", "empty", "broken", "too deep"
#: Brackets inside brackets that the JSON reader follows, those of whole_json included.
DEEPEST = 1000


def _between_keys(payload: Column) -> Column:
    return F.concat(F.lit('{"value":'), payload, F.lit(',"end":true}'))


def whole_json(payload: Column) -> Column:
    """Variant of a JSON text; null where it is broken, cut off or followed by anything."""
    return F.try_variant_get(F.try_parse_json(_between_keys(payload)), "$.value", "variant")


def whole_json_as(payload: Column, schema: str) -> Column:
    """The same with a schema."""
    read = F.from_json(_between_keys(payload), f"value {schema}, end BOOLEAN")
    return bind(read, lambda r: F.when(r["end"], r["value"]))


def nesting(payload: Column) -> Column:
    """How many brackets are open at most, those inside strings aside."""
    brackets = F.regexp_replace(F.regexp_replace(payload, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    one = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(state: Column, bracket: Column) -> Column:
        now = state["open"] + F.when(bracket.isin("[", "{"), 1).when(bracket == "", 0).otherwise(-1)
        return F.struct(now.alias("open"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), one, step)["most"]


def payload_status(payload: Column, failed: Column, items: Column) -> Column:
    """The status of a payload: ``failed`` says that it could not be read, ``items`` how much is in it.

    Nesting is only looked at where a payload could not be read.
    """
    deep = nesting(F.coalesce(payload, F.lit(""))) >= DEEPEST
    return (
        F.when(failed, F.when(deep, TOO_DEEP).otherwise(BROKEN)).when(F.coalesce(items, F.lit(0)) == 0, EMPTY).otherwise(OK)
    )
