"""Licence scan by a positional index of rare words, with built-in expressions only.

A template is the wording of a notice and, inside it, a mandatory key phrase. The index holds, for each
template, the two words of its key phrase that the fewest documents hold (the highest inverse document frequency,
counted over the whole corpus) with their places in the phrase. A document's words are looked up there;
the places at which both rare words stand at the right distance are candidates; at these the key phrase
must stand word by word. The share of the template's words that stand in place is the score.

A phrase that stands in a text holds its rare words at their places, so no place is lost. The index is as
large as the list of templates. Each document is read on its own: nothing is shuffled but the counts.

Defined cases: a null or empty text has no words and no labels (empty strings, null places, score 0);
repeated rows come out as often as they go in; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE_WORDS = 2


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def phrase(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        n = len(self.phrase)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.phrase)


# Notices and key phrases.
TEMPLATES = [
    Template("mit", "under the mit license", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", "cc by nc", base=True),
    Template("mit", "spdx license identifier mit", "spdx license identifier mit"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template("apache-2", "spdx license identifier apache 2 0", "license identifier apache 2"),
    Template("cc-by", "creative commons attribution 4 0 international", "creative commons attribution 4"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international", "creative commons attribution noncommercial"),
    Template("cc0", "creative commons cc0 1 0 universal", "cc0 1 0"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "in source and binary forms"),
    Template("bsd", "licensed under the bsd 3 clause license", "bsd 3 clause"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]


def words_of(text: Column) -> Column:
    """The words with A-Z lower-cased. Two letters beyond ASCII that would turn into ASCII ones are
    replaced by others, as only A-Z are to be lower-cased."""
    kept = F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.regexp_extract_all(F.lower(kept), F.lit(WORD), F.lit(0))


def document_counts(docs: DataFrame, templates: list[Template]) -> dict[str, int]:
    """For each word of a key phrase, how many documents hold it. As many rows as such words."""
    vocabulary = sorted({w for t in templates for w in t.phrase})
    listed = F.array(*[F.lit(w) for w in vocabulary])
    held = docs.select(F.explode(F.array_intersect(words_of(whole_text()), listed)).alias("word"))
    counted = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def rare_places(template: Template, counts: dict[str, int]) -> list[tuple[str, int]]:
    """The rarest words of the key phrase with their places in it, ties by place."""
    ranked = sorted(range(len(template.phrase)), key=lambda i: (counts[template.phrase[i]], i))
    return [(template.phrase[i], i) for i in (ranked * RARE_WORDS)[:RARE_WORDS]]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _index(templates: list[Template], counts: dict[str, int]) -> Column:
    entries = []
    for t in templates:
        (rare_a, at_a), (rare_b, at_b) = rare_places(t, counts)
        values = {"label": t.label, "base": t.base, "a": rare_a, "at_a": at_a, "b": rare_b, "at_b": at_b, "key_at": t.key_at}
        fields = [F.lit(v).alias(k) for k, v in values.items()]
        entries.append(F.struct(*fields, _strings(t.words).alias("words"), _strings(t.phrase).alias("phrase")))
    return F.array(*entries)


def _starts(words: Column, word: Column, at: Column) -> Column:
    """Where a phrase would start for each place of one of its words."""
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == word)
    return F.transform(places, lambda i: i - at)


def _found(words: Column, entry: Column) -> Column:
    """(label, base, at, score) of each place of a template's key phrase."""
    both = F.array_intersect(_starts(words, entry["a"], entry["at_a"]), _starts(words, entry["b"], entry["at_b"]))
    length = F.size(entry["phrase"])
    standing = F.filter(both, lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, length) == entry["phrase"]))

    def place(at: Column) -> Column:
        whole = F.size(entry["words"])
        same = lambda k: F.coalesce(F.get(words, at - entry["key_at"] + k) == F.get(entry["words"], k), F.lit(False))
        in_place = F.size(F.filter(F.sequence(F.lit(0), whole - 1), same))
        return F.struct(entry["label"].alias("label"), entry["base"].alias("base"), at.alias("at"), (in_place / whole).alias("score"))

    return F.transform(standing, place)


def license_places(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places), places being an array of (label, base, at, score), one row per document."""
    counts = document_counts(docs, templates)
    rare = _strings(sorted({w for t in templates for w, _ in rare_places(t, counts)}))
    worded = docs.select("doc_id", words_of(whole_text()).alias("words"))
    looked = worded.select("doc_id", "words", F.array_intersect("words", rare).alias("rare"))

    def places(words: Column, held: Column) -> Column:
        hit = F.filter(
            _index(templates, counts), lambda e: F.array_contains(held, e["a"]) & F.array_contains(held, e["b"])
        )
        return F.flatten(F.transform(hit, lambda e: _found(words, e)))

    none = F.array().cast("array<struct<label: string, base: boolean, at: int, score: double>>")
    found = F.when(F.size("rare") > 0, places(F.col("words"), F.col("rare"))).otherwise(none)
    return looked.select("doc_id", F.size("words").cast("long").alias("n_words"), found.alias("places"))


def license_labels(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per document."""

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    found = license_places(docs, templates)
    base = found.withColumn("base", F.filter("places", lambda p: p["base"]))
    starts = F.transform("base", lambda p: p["at"])
    return base.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
