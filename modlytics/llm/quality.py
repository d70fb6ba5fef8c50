"""Quality rules: repetition and length rules, then the distance of a text from its language.

A text's characters, by class, and its words, by place in a list of common words, are two
histograms. Both are compared with the mean histograms of the language by the Jensen-Shannon distance
(square root of the divergence to base 2, so 0 to 1). A text further away than a threshold goes. Short
texts have uneven histograms by chance, so the characters count from MIN_CHARS and the words from
MIN_WORDS on, with a limit that is the wider the fewer words there are.

The references are means over all documents of a language that are long enough, each document with the
same weight: one of the characters for each value of lang, and one of the words for each language with
a list. They are a table that meets the documents on lang. A language without a list needs LEAST_ROWS such
documents; a rarer one has no reference, as a mean over several scripts fits none of them, and goes by
the base rules only, as does a null language.

Defined cases: a null text has no words and fails the base rules, as do all texts of under 20
words; an empty table gives no rows; repeated rows come out as often as they go in. Only doc_id, text and
lang are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import packed, stored, unpacked

MIN_WORDS = 20
MIN_CHARS = 200
#: Distance of the characters beyond which a text goes.
CHARS_AWAY = 0.30
#: Distance of the words beyond which a text goes: for endless texts, and what is added over the root of the number of words.
WORDS_AWAY = 0.20
WORDS_CHANCE = 1.2
#: How far the sum of both distances may be beyond the limit of the words.
BOTH_MORE = 0.20

BASE_MIN_WORDS = 20
WINDOW = 8
SYMBOLS = "#*$%&|<>"

# Frequent words of each listed language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son elle".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
#: Documents from which on a language without a list has a reference.
LEAST_ROWS = 50
#: Languages that a task remembers; partial sums go out when there are more.
REMEMBERED = 1000

_CLASSES = [
    "space", "line", "vowel", "consonant", "upper", "digit", "stop", "comma", "quote", "symbol", "dash", "other-ascii",
    "accented", "accented-upper", "other-letter", "rest",
]


def _class_of(code: int) -> int:
    c = chr(code)
    if c == "\n":
        name = "line"
    elif c in " \t\v\f\r":
        name = "space"
    elif code < 128:
        kinds = {"aeiou": "vowel", ".!?": "stop", ",;:": "comma", "'\"`()": "quote", "-_/": "dash", SYMBOLS: "symbol"}
        listed = [kind for chars, kind in kinds.items() if c in chars]
        name = listed[0] if listed else "upper" if c.isupper() else "consonant" if c.islower() else "digit" if c.isdigit() else "other-ascii"
    elif code < 0x250 and c.isalpha():
        name = "accented-upper" if c.isupper() else "accented"
    else:
        name = "other-letter" if unicodedata.category(c)[0] in "LM" else "rest"
    return _CLASSES.index(name)


def _tables() -> tuple[np.ndarray, dict[str, dict[bytes, int]]]:
    """Class of every code point of the first plane, and the place of each common word."""
    classes = np.fromiter((_class_of(i) if not 0xD800 <= i < 0xE000 else len(_CLASSES) - 1 for i in range(0x10000)), np.uint8, 0x10000)
    return classes, {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in COMMON.items()}


def _repeated(ids: np.ndarray) -> int:
    """Words in windows of WINDOW words that are found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    width = 1
    while width < WINDOW:  # exact names of windows of 2, 4, 8 words
        ids = np.unique(ids[:-width] * (int(ids.max()) + 1) + ids[width:], return_inverse=True)[1]
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(ids) + WINDOW, np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")] if "\n" in text else []
    numbers: dict[bytes, int] = {}
    repeated = 0
    if len(words) > WINDOW:
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        repeated = _repeated(ids)
    return word_chars, n_symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < BASE_MIN_WORDS or 100 * n_repeat_words > 30 * n_words


class Histograms:
    """Histograms of texts, as shares."""

    def __init__(self) -> None:
        self.classes, self.common = _tables()

    def chars(self, text: str) -> np.ndarray:
        counts = np.zeros(len(_CLASSES))
        for at in range(0, len(text), 1 << 20):
            codes = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "replace"), "<u4")
            counts += np.bincount(self.classes[np.minimum(codes, 0xFFFF)], minlength=len(_CLASSES))
        return counts / max(1, len(text))

    def words(self, words: list[bytes], lang: str) -> np.ndarray:
        places = self.common.get(lang, {})
        counts = np.zeros(len(next(iter(COMMON.values()))) + 1)
        for w in words:
            at = places.get(w.strip(b".,;:!?").lower())
            if at is not None:
                counts[at] += 1
        counts[-1] = len(words) - counts.sum()
        return counts / max(1, len(words))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of shares."""
    mean = (p + q) / 2
    parts = [np.sum(x[x > 0] * np.log2(x[x > 0] / mean[x > 0])) for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(parts) / 2)))


def words_limit(n_words: int) -> float:
    """Distance of the words beyond which a text of so many words goes."""
    return WORDS_AWAY + WORDS_CHANCE / float(np.sqrt(n_words))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the histograms of a task, one row for each language, kind and bin."""
    made = Histograms()
    sums: dict[tuple[str, str], list] = {}

    def partial() -> pa.RecordBatch:
        rows = [(lang, kind, n, i, float(v)) for (lang, kind), (n, total) in sums.items() for i, v in enumerate(total)]
        sums.clear()
        table = pd.DataFrame(rows, columns=["lang", "kind", "n", "bin", "total"])
        return pa.RecordBatch.from_pandas(table.astype({"n": "int64", "bin": "int64", "total": "float64"}), schema=_SUMS)

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if not text or lang is None:
                continue
            words = text.encode("utf-8", "replace").split()
            found = []
            if len(text) >= MIN_CHARS:
                found.append(("chars", made.chars(text)))
            if len(words) >= MIN_WORDS and lang in COMMON:
                found.append(("words", made.words(words, lang)))
            for kind, histogram in found:
                entry = sums.setdefault((lang, kind), [0, 0.0])
                entry[0] += 1
                entry[1] = entry[1] + histogram
            if len(sums) >= REMEMBERED:
                yield partial()
    yield partial()


_SUMS = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("bin", pa.int64()), ("total", pa.float64())])

References = dict[tuple[str, str], np.ndarray]


def reference_table(docs: DataFrame) -> DataFrame:
    """(of_lang, of_chars, of_words): mean histograms over all documents, one row for each language that has
    one. Rounding makes them the same whatever the order of the sums."""
    sums = docs.select("text", "lang").mapInArrow(_sums, "lang string, kind string, n long, bin long, total double")
    means = sums.groupBy("lang", "kind", "bin").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    means = means.filter(F.col("lang").isin(*COMMON) | (F.col("n") >= LEAST_ROWS))
    share = F.struct("bin", F.round(F.col("total") / F.col("n"), 9).alias("share"))

    def histogram(kind: str) -> Column:
        bins = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, share)))
        return F.transform(bins, lambda x: x["share"])

    return means.groupBy(F.col("lang").alias("of_lang")).agg(histogram("chars").alias("of_chars"), histogram("words").alias("of_words"))


def _known(lang: str | None, chars: Sequence[float] | None, words: Sequence[float] | None) -> References:
    kinds = {"chars": chars, "words": words}
    return {(lang, kind): np.array(shares) for kind, shares in kinds.items() if shares is not None and len(shares)}


def references(docs: DataFrame) -> References:
    """The same as a dictionary by language and kind, for tables of few languages."""
    return {key: shares for row in reference_table(docs).collect() for key, shares in _known(*row).items()}


def _with_references(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (with lang) and the reference of their language, if it has one. The references are written first,
    so Spark knows how small they are and need not shuffle the texts."""
    table = stored(reference_table(docs), "quality-references")
    return rows.join(table, F.col("lang") == F.col("of_lang"), "left")


def _verdicts(texts: list, langs: list, chars: list, words: list, made: Histograms, seen: dict[str | None, References]) -> Iterator[tuple]:
    """seen keeps the references of the languages that came by."""
    for text, lang, *shares in zip(texts, langs, chars, words, strict=True):
        if lang not in seen:
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen[lang] = _known(lang, *(None if s is None else s.as_py() for s in shares))
        yield verdict(made, seen[lang], text or "", lang)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made, seen = Histograms(), {}
    for batch in batches:
        ids, texts, langs, chars, words = batch.columns
        rows = list(_verdicts(texts.to_pylist(), langs.to_pylist(), chars, words, made, seen))
        columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(_VERDICT)
        arrays = [pa.array(c, t) for c, t in zip(columns, _VERDICT.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([ids, *arrays], ["doc_id", *_VERDICT])


_VERDICT = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "chars_away": pa.float64(), "words_away": pa.float64(),
    "kept": pa.bool_(),
}


def verdict(made: Histograms, known: References, text: str, lang: str | None) -> tuple:
    """The values of _VERDICT. A distance is null where the text is too short or has no reference."""
    words = text.encode("utf-8", "replace").split()
    counts = base_counts(text, words)
    failed = base_failed(len(words), counts[3])
    chars = known.get((lang, "chars")) if len(text) >= MIN_CHARS else None
    common = known.get((lang, "words")) if len(words) >= MIN_WORDS else None
    chars_away = None if chars is None else distance(made.chars(text), chars)
    words_away = None if common is None else distance(made.words(words, lang), common)
    far = (chars_away or 0.0) > CHARS_AWAY
    if words_away is not None:
        limit = words_limit(len(words))
        far = far or words_away > limit or (chars_away or 0.0) + words_away > limit + BOTH_MORE
    return len(words), *counts, failed, chars_away, words_away, not failed and not far


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, chars_away, words_away, kept), one row per document."""
    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *(f"{name} {kinds[t]}" for name, t in _VERDICT.items())])
    rows = _with_references(docs, docs.select("doc_id", "text", "lang"))
    return rows.select("doc_id", "text", "lang", "of_chars", "of_words").mapInArrow(_judged, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""

    def keeps(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        made, seen = Histograms(), {}
        for texts, langs, chars, words in batches:
            found = _verdicts(texts.to_pylist(), langs.to_pylist(), chars, words, made, seen)
            yield pa.array([v[-1] for v in found], pa.bool_())

    keeps.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    # The row as one column, so that no extra column can clash with those of the references.
    rows = _with_references(docs, packed(docs).select("row", F.col("row.text").alias("text"), F.col("row.lang").alias("lang")))
    return unpacked(rows.filter(F.arrow_udf(keeps, "boolean")("text", "lang", "of_chars", "of_words")).select("row"))
