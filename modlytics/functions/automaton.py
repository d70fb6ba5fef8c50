"""Term lists as versions of a table, found with their places in one walk.

A version has tiers in order, each with its entries in order; an entry may stand twice. One automaton per version, built
once in each task from the version's entries, goes through a lower-cased text once and gives every place of every
entry of all tiers. The lists of the rules are version RULES; a user's own lists are further versions of the same table.

A version is small (MOST_TERMS entries at most, or an error), so it travels with the tasks.

Defined cases: a null text has no hits; an empty entry is left out; a version without entries has no hits; a text without a
hit has an empty list.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.functions import dictionary as fixed
from modlytics.functions.slices import sliced

# Functions travel with their tasks by value, as executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULES = "rules-1"
TERM_LIST = "version STRING, tier INT, label STRING, place INT, term STRING"
MOST_TERMS = 100_000
#: Tiers of the rules, gravest first.
TIERS = [
    (fixed.HARMFUL, fixed.HARMFUL_TERMS),
    (fixed.ABUSIVE, fixed.ABUSIVE_TERMS),
    (fixed.TOXIC, fixed.TOXIC_TERMS),
    (fixed.SPAM, fixed.SPAM_TERMS),
]
HITS = "array<struct<tier: int, place: int, term: string, starts: array<int>>>"


def rule_terms(spark: SparkSession) -> DataFrame:
    """The lists of the rules as a version of the table."""
    rows = [(RULES, tier, label, place, term) for tier, (label, terms) in enumerate(TIERS) for place, term in enumerate(terms)]
    return spark.createDataFrame(rows, TERM_LIST)


@dataclass(frozen=True)
class Version:
    """(tier, place, term) of a version's entries, in order."""

    name: str
    entries: tuple[tuple[int, int, str], ...]


def load_version(table: DataFrame, name: str) -> Version:
    """One version of a table of term lists. Terms are taken in lower case, as texts are."""
    rows = table.filter(F.col("version") == name).select("tier", "place", F.lower("term").alias("term")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"version {name} has more than {MOST_TERMS} entries")
    return Version(name, tuple(sorted((r["tier"], r["place"], r["term"]) for r in rows if r["term"])))


def _automaton(entries: tuple[tuple[int, int, str], ...]):
    """The automaton of a version's entries; None if there are none."""
    import ahocorasick  # executors need it only where versions are used

    machine = ahocorasick.Automaton()
    for _, _, term in entries:
        machine.add_word(term, term)
    machine.make_automaton()
    return machine if entries else None


def find_terms(lowered: str, entries: tuple[tuple[int, int, str], ...], machine) -> list[dict]:
    """(tier, place, term, starts) of each entry that a lower-cased text holds, in the order of the lists. Starts are all places,
    overlapping ones too, in code points."""
    if machine is None:
        return []
    starts: dict[str, list[int]] = {}
    for end, term in machine.iter(lowered):
        starts.setdefault(term, []).append(end - len(term) + 1)
    if not starts:
        return []
    return [{"tier": tier, "place": place, "term": term, "starts": starts[term]} for tier, place, term in entries if term in starts]


def _once(entries: tuple[tuple[int, int, str], ...]):
    """Gives the automaton of a version, built at the first call in a task."""
    built: list = []

    def machine():
        if not built:
            built.append(_automaton(entries))
        return built[0]

    return machine


def term_places(version: Version):
    """An expression of a lower-cased text: its hits of a version, with their places."""
    entries, machine_of = version.entries, _once(version.entries)

    def search(texts: pa.Array) -> pa.Array:
        machine = machine_of()
        found = [find_terms(t, entries, machine) if t else [] for t in texts.to_pylist()]
        kind = pa.list_(pa.struct([("tier", pa.int32()), ("place", pa.int32()), ("term", pa.string()), ("starts", pa.list_(pa.int32()))]))
        return pa.array(found, kind)

    return sliced(search, HITS)


def hits_of_tier(hits: Column, tier: int) -> Column:
    """The entries of a tier, in list order, duplicates kept."""
    return F.transform(F.filter(hits, lambda h: h["tier"] == tier), lambda h: h["term"])


def deciding_hits(version: Version):
    """As rules.deciding_hits, from a version's tiers: the first tier with a hit and its hits. The last tier also counts links, and
    a flood of emoji comes after all tiers. An expression of a lower-cased text."""
    places = term_places(version)

    def decide(lowered: Column) -> Column:
        def of(hits: Column) -> Column:
            link = F.when(F.regexp_like(lowered, F.lit(fixed.LINK_PATTERN)), F.array(F.lit(fixed.URL_TAG))).otherwise(F.array().cast("array<string>"))
            last = len(TIERS) - 1
            tiers = [hits_of_tier(hits, tier) for tier in range(last)] + [F.concat(hits_of_tier(hits, last), link)]
            flood = F.regexp_like(lowered, F.lit(fixed.EMOJI_FLOOD_PATTERN))
            found = F.when(flood, _found(last + 1, F.array(F.lit(fixed.EMOJI_TAG)))).otherwise(_found(-1, F.array().cast("array<string>")))
            for tier in range(last, -1, -1):
                found = F.when(F.size(tiers[tier]) > 0, _found(tier, tiers[tier])).otherwise(found)
            return found

        return F.transform(F.array(places(lowered)), of)[0]

    return decide


def _found(place: int, hits: Column) -> Column:
    return F.struct(F.lit(place).alias("place"), hits.alias("hits"))


# --- marking by places ---

#: Letters beyond ASCII that match an ASCII one when case does not count. Fixed values.
_FOLDED = str.maketrans({"K": "k", "ſ": "s", "ı": "i", "İ": "i"})


def lower_case(text: str) -> str:
    """The text in lower case, letter by letter, so that places stay."""
    lowered = text.translate(_FOLDED).lower()
    return lowered if len(lowered) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text.translate(_FOLDED))


def all_places(text: str, token: str) -> list[int]:
    """Every start of a token, overlapping ones too."""
    found, at = [], text.find(token)
    while at >= 0:
        found.append(at)
        at = text.find(token, at + 1)
    return found


def mark_places(text: str, tokens: list[tuple[str, list[int]]], opening: str, closing: str) -> str:
    """The text with tokens marked in turn, by where each can start, in order.

    A token is marked from left to right, without overlaps. An occurrence that an earlier mark cuts through is none, as the marks
    stand in the text by then. Marks of one place nest in the order in which they were made.
    """
    opened: dict[int, int] = {}
    closed: dict[int, int] = {}
    cuts: set[int] = set()
    for token, starts in tokens:
        n, free, made = len(token), 0, []
        held = sorted(cuts)
        for start in starts:
            after = bisect_right(held, start)
            if start >= free and not (after < len(held) and held[after] < start + n):
                made.append(start)
                free = start + n
        for start in made:
            opened[start] = opened.get(start, 0) + 1
            closed[start + n] = closed.get(start + n, 0) + 1
        cuts.update(p for start in made for p in (start, start + n))
    if not cuts:
        return text
    places = sorted(cuts)
    parts, at = [], 0
    for place in places:
        parts += [text[at:place], closing * closed.get(place, 0), opening * opened.get(place, 0)]
        at = place
    return "".join([*parts, text[at:]])


def highlight_places(version: Version, opening: str = "<mark>", closing: str = "</mark>"):
    """An expression of (text, trigger string): the text with its triggers marked, as text.highlight does, from places. One walk
    finds those of the version's terms; triggers that are none of these are looked for one by one."""
    entries = version.entries
    machine_of = _once(entries)
    known = {term for _, _, term in entries}
    tags = frozenset(fixed.SYSTEM_TAGS)
    blanks = fixed.BLANKS

    def one(text: str, flagged: str, machine) -> str:
        wanted = [t for t in (part.strip(blanks) for part in flagged.split(",")) if t and t not in tags]
        wanted.sort(key=len, reverse=True)
        if not wanted:
            return text
        lowered = lower_case(text)
        places = {h["term"]: h["starts"] for h in find_terms(lowered, entries, machine)}
        tokens = []
        for token in wanted:
            low = lower_case(token)
            tokens.append((token, places.get(low, []) if low in known else all_places(lowered, low)))
        return mark_places(text, tokens, opening, closing)

    def mark(texts: pa.Array, triggers: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), triggers.to_pylist(), strict=True)
        machine = machine_of()
        return pa.array([None if t is None else one(t, f or "", machine) for t, f in pairs], pa.string())

    return sliced(mark, "string")
