"""Filter interaction audit: what each filter removes, in every order of filters.

A table-driven byte transducer reads each text's UTF-8 once. It has two states, outside and inside of a
word; a byte's class and the state give the next state and what is emitted: the start or end of a word, a
capital, a code point, a symbol. As the next state depends on the last byte's class alone, whole buffers
are read with table look-ups. Word spans go into an open-addressed hash table; a span counts as seen only if
the bytes of the one in its slot are the same, so a collision of hashes never merges two words.

Filters (a document fails at): A too few words, B too few different words, C too many capitals, D a symbol,
E a smaller doc_id with the same text anywhere in the table. Five filters fail in 32 ways, so a part of the
corpus is 32 counts, and all 120 orders are worked out on these counts alone. Texts are compared by SHA-256.
Copies are found by partial minima per digest, and labels meet one row per document, so neither a large
group of copies nor a large part sends its rows to one task.

Defined cases: a null text counts as empty, which has no words and fails A, not B or C; a null part counts as
the empty string; a row without a doc_id never fails E and has no labels; repeated rows count as often as
they occur, and rows with one doc_id are not copies of each other; of several labels of a document each
counts if any row has it; an empty table gives no rows. A part has 600 rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from modlytics.llm.common import stored

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
SYMBOLS = b"#$%&*|"

#: Bytes that are worked through at once, at least one text.
SLICE = 1 << 22
#: Words of more bytes are hashed and compared one by one.
LONG_WORD = 64

OUTSIDE, INSIDE = range(2)
SPACE, CAPITAL, SYMBOL, INNER, OTHER = range(5)
STARTS, ENDS, IS_CAPITAL, IS_POINT, IS_SYMBOL = (1 << i for i in range(5))

#: The class of each byte; INNER is a byte inside a code point.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*b"\x20\x09\x0a\x0b\x0c\x0d"]] = SPACE
CLASS[ord("A") : ord("Z") + 1] = CAPITAL
CLASS[[*SYMBOLS]] = SYMBOL
CLASS[0x80:0xC0] = INNER

#: By state and class.
NEXT = np.full((2, 5), INSIDE, np.uint8)
NEXT[:, SPACE] = OUTSIDE
EMIT = np.full((2, 5), IS_POINT, np.uint8)
EMIT[:, CAPITAL] |= IS_CAPITAL
EMIT[:, SYMBOL] |= IS_SYMBOL
EMIT[:, INNER] = 0
EMIT[OUTSIDE, 1:] |= STARTS
EMIT[INSIDE, SPACE] |= ENDS

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_FACTORS = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FACTORS[2]
    return x ^ (x >> np.uint64(29))


class Spans:
    """Words of several texts as spans of one buffer, each with a hash of its text's number and its bytes."""

    def __init__(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray) -> None:
        self.buffer, self.starts, self.ends, self.texts = buffer, starts, ends, texts
        self.lengths = ends - starts
        padded = np.frombuffer(buffer + bytes(8), np.uint8)
        #: The eight bytes from each place on, as one number.
        self.eights = np.ndarray((len(buffer),), "<u8", padded, strides=(1,))
        self.hashes = _mixed(texts.astype(np.uint64) * _FACTORS[0] + self.lengths.astype(np.uint64) * _FACTORS[1])
        self.long = self.lengths > LONG_WORD
        short = np.where(self.long, 0, self.lengths)
        for at in range(0, int(short.max(initial=0)), 8):
            rows = np.flatnonzero(short > at)
            self.hashes[rows] = _mixed(self.hashes[rows] ^ self._chunk(rows, at))
        for i in np.flatnonzero(self.long).tolist():
            digest = xxhash.xxh3_64_intdigest(buffer[starts[i] : ends[i]], int(self.hashes[i]))
            self.hashes[i] = digest

    def _chunk(self, words: np.ndarray, at: int) -> np.ndarray:
        return self.eights[self.starts[words] + at] & _MASKS[np.minimum(self.lengths[words] - at, 8)]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b are of one text and have the same bytes."""
        alike = (self.hashes[a] == self.hashes[b]) & (self.texts[a] == self.texts[b]) & (self.lengths[a] == self.lengths[b])
        left = np.flatnonzero(alike & ~self.long[a])
        at = 0
        while len(left := left[self.lengths[a[left]] > at]):
            equal = self._chunk(a[left], at) == self._chunk(b[left], at)
            alike[left[~equal]] = False
            left, at = left[equal], at + 8
        for i in np.flatnonzero(alike & self.long[a]).tolist():
            x, y = a[i], b[i]
            alike[i] = self.buffer[self.starts[x] : self.ends[x]] == self.buffer[self.starts[y] : self.ends[y]]
        return alike

    def first(self) -> np.ndarray:
        """One word of each set of equal words, by a hash table with linear probing.

        All words look at their slots at once: one of those at a free slot takes it, those equal to the word in
        their slot are done, and the others go on to the next slot.
        """
        n = len(self.starts)
        size = 1 << max(3, (2 * n - 1).bit_length())
        table = np.full(size, -1, np.int64)
        words, slots = np.arange(n), (self.hashes & np.uint64(size - 1)).astype(np.int64)
        found: list[np.ndarray] = []
        while len(words):
            free = table[slots] < 0
            table[slots[free]] = words[free]
            held = table[slots]
            won = held == words
            found.append(words[won])
            left = np.flatnonzero(~won)
            left = left[~self.same(words[left], held[left])]
            words, slots = words[left], (slots[left] + 1) & (size - 1)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def counts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(words, different words, capitals, code points, symbols) of each text."""
    buffer = b"\n".join([*texts, b""])  # what ends a text also ends its last word
    codes = CLASS[np.frombuffer(buffer, np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(lengths) - lengths
    states = np.empty_like(codes)
    states[0] = OUTSIDE
    states[1:] = NEXT[OUTSIDE][codes[:-1]]
    emitted = EMIT.ravel()[states * np.uint8(5) + codes]

    def per_text(flag: int) -> np.ndarray:
        return np.add.reduceat((emitted & flag) != 0, first, dtype=np.int64)

    words = per_text(STARTS)
    of = np.repeat(np.arange(len(texts)), words)
    spans = Spans(buffer, np.flatnonzero(emitted & STARTS), np.flatnonzero(emitted & ENDS), of)
    different = np.bincount(of[spans.first()], minlength=len(texts))
    return words, different, per_text(IS_CAPITAL), per_text(IS_POINT) - 1, per_text(IS_SYMBOL)


MEASURES = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., n_words, n_distinct, n_capitals, n_points, n_symbols, digest), one row per document."""
    own = ", ".join(f"{name} BIGINT" for name in MEASURES)
    schema = StructType([*docs.select(*keep).schema, *StructType.fromDDL(f"{own}, digest BINARY")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _slices(texts):
                found = [pa.array(c.astype(np.int64)) for c in counts(texts[a:b])]
                digests = pa.array([hashlib.sha256(t).digest() for t in texts[a:b]], pa.binary())
                kept = [c.slice(a, b - a) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, *found, digests], schema.fieldNames())

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return docs.select(text, *keep).mapInArrow(read, schema)


def _own_fails() -> Column:
    """The filters that a text fails on its own, as bits in the order of FILTERS."""
    tests = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT_PERCENT * F.col("n_words"),
        100 * F.col("n_capitals") > MOST_CAPITALS_PERCENT * F.col("n_points"),
        F.col("n_symbols") > 0,
    ]
    bits = [F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)]
    return sum(bits[1:], bits[0])


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, fails, n): n equal rows of a document and the filters they fail, as bits."""
    part_of = F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")
    measured = measures(docs.select("text", "doc_id", part_of), ["doc_id", "part"])
    rows = measured.groupBy("doc_id", "part", "digest", _own_fails().alias("own")).agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows, "measures")
    # The smallest id of each text; rows meet it by text and id, so a group of copies is no hot key.
    least = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    met = rows.join(least.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    copy = F.when(F.col("doc_id").isNull() | F.col("first").isNotNull(), 0).otherwise(1 << 4)
    return met.select("doc_id", "part", (F.col("own") + copy).alias("fails"), "n")


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """failures with (good, toxic)."""
    marks = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    return failed.join(marks.filter("doc_id is not null"), "doc_id", "left")


def _steps(parts: DataFrame) -> DataFrame:
    """Rows with every order and step: filter_order, step, the bit of its filter, and the bits of those before it."""
    orders = ",".join("".join(order) for order in permutations(FILTERS))
    drawn = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    drawn = drawn.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = f"transform(sequence(1, {len(FILTERS)}), k -> shiftleft(1, instr('{FILTERS}', substr(filter_order, k, 1)) - 1))"
    drawn = drawn.withColumn("bits", F.expr(bits)).withColumn("bit", F.expr("bits[step - 1]"))
    return drawn.withColumn("before", F.expr("aggregate(slice(bits, 1, step - 1), 0, (s, b) -> s + b)"))


def audit(failed: DataFrame) -> DataFrame:
    """with_labels -> (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Counts are partial before they are shuffled; a part is one row of at most 32 counts before its 600 rows are drawn.
    """

    def held(flag: str) -> Column:
        return F.sum(F.when(F.coalesce(flag, F.lit(False)), F.col("n")).otherwise(0))

    ways = failed.groupBy("part", "fails").agg(F.sum("n").alias("all"), held("good").alias("good"), held("toxic").alias("toxic"))
    parts = ways.groupBy("part").agg(F.collect_list(F.struct("fails", "all", "good", "toxic")).alias("ways"))

    def total(of: str, chosen: str) -> Column:
        """The sum over the ways to fail that are chosen, by an expression of a way's ``x.fails``."""
        return F.expr(f"aggregate(transform(ways, x -> if({chosen}, x.{of}, 0L)), 0L, (s, n) -> s + n)")

    fails, gone = "(x.fails & bit) > 0", "(x.fails & before) > 0"
    # Of the filters that a document fails, each is the first one in an equal share of all orders.
    share = f"if({fails}, x.all * ({factorial(len(FILTERS))} div bit_count(x.fails)), 0L)"
    return _steps(parts).select(
        "part",
        "filter_order",
        "step",
        total("all", f"not {fails} and not {gone}").alias("kept"),
        total("all", f"{fails} and not {gone}").alias("removed"),
        total("all", f"{fails} and {gone}").alias("redundant"),
        total("all", "x.fails = bit").alias("unique_fails"),
        total("good", f"{fails} and not {gone}").alias("good_lost"),
        total("toxic", f"{fails} and not {gone}").alias("toxic_lost"),
        F.expr(f"aggregate(transform(ways, x -> {share}), 0L, (s, n) -> s + n)").alias("shapley"),
    )
