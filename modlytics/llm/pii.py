"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one walk: at-signs, digits, plus signs before
digits, schemes and identifier cues. A local parser expands each anchor to the left and right, and
checks what it found. Per kind, spans are leftmost and don't overlap; a span that fails its check is
dropped and nothing inside it is tried again.

Base kinds: email, ip, card, phone. The method's own: ``login`` (user and password in a URL), ``iban``
(after its cue, with valid check digits), ``account`` (6 to 17 digits after an account cue).

Positions count code points, ends are exclusive. Defined cases: a null or empty text has no spans;
repeated rows come out as often as they go in; an empty table gives no rows. Only doc_id and text are
read. A text is worked through whole, with memory for its spans only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "login", "iban", "account"]

#: Words that announce an account number, and what may stand between them and it.
ACCOUNT_CUES = ["account", "Account", "ACCOUNT", "acct", "Acct", "konto", "Konto", "compte", "Compte", "cuenta", "Cuenta"]
IBAN_CUES = ["IBAN", "iban", "Iban"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/@:?#]+:[^\s/@?#]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[\s:]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: (?:no|nr|number|num))?[.:#]?\s?(?<![A-Za-z])([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")

Span = tuple[str, int, int]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", "at")
    found.add_word("://", "scheme")
    for digit in "0123456789":
        found.add_word(digit, "digit")
        found.add_word("+" + digit, "plus")
    for cue in IBAN_CUES:
        found.add_word(cue, "iban")
    for cue in ACCOUNT_CUES:
        found.add_word(cue, "account")
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _email(text: str, at: int, after: int) -> tuple[int, int] | None:
    start = at
    while start > after and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    domain = _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain else None


def _iban_valid(value: str) -> bool:
    compact = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans, by kind as listed in KINDS and then by start."""
    spans: list[Span] = []
    past = dict.fromkeys(KINDS, 0)  # per kind, where the next span may start

    def take(kind: str, start: int, end: int, valid: bool) -> None:
        past[kind] = end
        if valid:
            spans.append((kind, start, end))

    for last, what in anchors.iter(text):
        if what == "digit":
            # A span starts at the first digit of a run.
            if last > 0 and "0" <= text[last - 1] <= "9" and last != past["ip"] and last != past["card"]:
                continue
            if last >= past["ip"] and (m := _IP.match(text, last)):
                take("ip", last, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")))
            if last >= past["card"] and (m := _CARD.match(text, last)):
                digits = m[0].replace(" ", "").replace("-", "")
                take("card", last, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
        elif what == "at":
            if email := _email(text, last, past["email"]):
                take("email", *email, True)
        elif what == "plus":
            if last - 1 >= past["phone"] and (m := _PHONE.match(text, last - 1)):
                take("phone", last - 1, m.end(), 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15)
        elif what == "scheme":
            if m := _LOGIN.match(text, last - 2):
                start = last - 2
                while start > past["login"] and text[start - 1] in _SCHEME:
                    start -= 1
                if start < last - 2:
                    take("login", start, m.end(), True)
        elif what == "iban":
            if last >= past["iban"] and (m := _IBAN.match(text, last + 1)):
                take("iban", m.start(1), m.end(1), _iban_valid(m[1]))
        elif last >= past["account"] and (m := _ACCOUNT.match(text, last + 1)):
            take("account", m.start(1), m.end(1), True)
    order = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (order[s[0]], s[1]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        found = [
            [{"kind": k, "start": a, "end": b} for k, a, b in spans_of(text or "", anchors)]
            for text in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], ["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans), one row per document; spans is an array of (kind, start, end)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(_find, schema)
