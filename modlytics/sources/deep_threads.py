"""Threads that are nested deeper than Spark's JSON reader goes.

Only payloads with that status come here, one at a time and whole. They are read token by token with a stack of their
own, so depth costs no more than length, and give what ``threads`` gives of others: the same comments in the same
order, title and status. Comments have no paths, as they come out in order.

Defined cases: a payload that is cut off, broken, followed by anything or has a key twice is broken; a number or truth value
in place of a text is taken as it is written, anything else there is missing.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from modlytics.functions.dictionary import REMOVED_BODIES, THREAD_TITLE

# Functions travel with their tasks by value, as executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TOKEN = re.compile(
    r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\.)*+")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null)|([\[\]{},:]))',
    re.S,
)
_REST = re.compile(r"[ \t\n\r]*\Z")
_CLOSES = {"]": list, "}": dict}


class Number(str):
    """A number as it is written."""


def parse(text: str):
    """The value of a JSON text, nested as deeply as may be. Raises ValueError where it isn't one."""
    root, at, done = None, 0, False
    stack: list[list | dict] = []
    keys: list[str] = []
    expected = "value"
    while not done:
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError(f"no token at {at}")
        at = token.end()
        string, number, word, mark = token.groups()
        if expected == "colon":
            if mark != ":":
                raise ValueError(f"no colon at {at}")
            expected = "value"
            continue
        if expected.startswith("key") and string is not None:
            keys.append(json.loads(string))
            expected = "colon"
            continue
        if expected == "after" and mark == ",":
            expected = "value" if isinstance(stack[-1], list) else "key"
            continue
        if mark in _CLOSES and (expected == "after" or expected.endswith("or end")) and isinstance(stack[-1], _CLOSES[mark]):
            stack.pop()
        elif expected.startswith("value") and (mark in ("[", "{") or mark is None):
            value = json.loads(string) if string is not None else Number(number) if number is not None else json.loads(word) if word else [] if mark == "[" else {}
            if not stack:
                root = value
            elif isinstance(stack[-1], list):
                stack[-1].append(value)
            else:
                key = keys.pop()
                if key in stack[-1]:
                    raise ValueError(f"{key!r} twice")
                stack[-1][key] = value
            if mark is not None:
                stack.append(value)
                expected = "value or end" if mark == "[" else "key or end"
                continue
        else:
            raise ValueError(f"not expected at {at}")
        expected, done = "after", not stack
    if not _REST.match(text, at):
        raise ValueError(f"more at {at}")
    return root


def _at(value, *path):
    """What is at a path of keys and places; None where there is nothing."""
    for step in path:
        if isinstance(step, int):
            value = value[step] if isinstance(value, list) and len(value) > step else None
        else:
            value = value.get(step) if isinstance(value, dict) else None
    return value


def _text(value) -> str | None:
    if isinstance(value, bool):
        return str(value).lower()
    # Half a surrogate pair is no character.
    return value.encode("utf-8", "replace").decode() if isinstance(value, str) else None


def _number(value) -> float | None:
    try:
        return float(value) if isinstance(value, (str, bool)) else None
    except ValueError:
        return None


def read_deep(payload: str) -> tuple[str, str, list[tuple]]:
    """(status, title, (author, body, created_utc) of each comment in order)."""
    try:
        tree = parse(payload)
    except ValueError:
        return "broken", THREAD_TITLE, []
    title = _text(_at(tree, 0, "data", "children", 0, "data", "title"))
    top = _at(tree, 1, "data", "children")
    if not isinstance(top, list):
        return "broken", title if title is not None else THREAD_TITLE, []
    found = []
    left = top[::-1]
    while left:
        node = left.pop()
        if _at(node, "kind") != "t1":
            continue
        body = _text(_at(node, "data", "body"))
        if body and body not in REMOVED_BODIES:
            found.append((_text(_at(node, "data", "author")), body, _number(_at(node, "data", "created_utc"))))
        replies = _at(node, "data", "replies", "data", "children")
        if isinstance(replies, list):
            left += replies[::-1]
    return "ok" if found else "empty", title if title is not None else THREAD_TITLE, found


_COMMENT = pa.struct([("path", pa.list_(pa.int32())), ("author", pa.string()), ("body", pa.string()), ("created_utc", pa.float64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, payload in enumerate(batch.column(3).to_pylist()):
            status, title, found = read_deep(payload)
            comments = [{"path": [], "author": a, "body": b, "created_utc": c} for a, b, c in found]
            columns = [pa.array([status]), pa.array([title]), pa.array([comments], pa.list_(_COMMENT))]
            names = ["profile_url", "landed_at", "page", "status", "title", "comments"]
            yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns[:3]], *columns], names)


def read_deep_threads(unread: DataFrame) -> DataFrame:
    """(profile_url, landed_at, page, unread) -> as threads.read_threads, one row per payload."""
    comments = "ARRAY<STRUCT<path: ARRAY<INT>, author: STRING, body: STRING, created_utc: DOUBLE>>"
    schema = f"profile_url STRING, landed_at TIMESTAMP, page BIGINT, status STRING, title STRING, comments {comments}"
    return unread.select("profile_url", "landed_at", "page", "unread").mapInArrow(_read, schema)
