"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, one on ordinary and one on toxic text. A text is read in
overlapping windows of WINDOW_WORDS words, each set before a fixed carrier, as no match is sought in the
last bytes of what is compressed (words over WORD_BYTES are cut). A window is compressed with the
ordinary dictionary alone and with the toxic one before it, so that ordinary words cost the same both
times; how many bytes the toxic one saves is the window's distance. Most windows hold nothing that the toxic one alone has;
these save nothing, exactly, and are not compressed. The largest saving and the
shares of windows with large savings are calibrated to a probability by logistic regression, on texts
that the dictionaries which score them have not seen: texts are dealt into SPLITS parts, and each part is
scored by dictionaries of the others. The dictionaries of all parts then score the corpus.

A label marks a whole document, most of which is as ordinary as any other. Toxic text for the dictionary
is therefore what is salient in toxic documents: words that hold a run of GRAM bytes, and phrases of two or
three other words, that are RATIO times as frequent there as in ordinary documents, counted in documents,
and more often than by chance. A text most of whose phrases stand in texts before it is a copy and
not counted again.

Training reads a bounded sample: at most TOXIC_ROWS and ORDINARY_ROWS labelled rows of up to LONGEST code
points, the first by hash of doc_id (120 MB on the driver at most, in ASCII); of their text, at most
ORDINARY_WINDOWS windows and SAME_SPAN occurrences of each salient span train the dictionaries. Rows whose
crc32 of doc_id (as text) is 0 modulo FOLDS are held out and never read.
Scores use the text only. Everything else reads all rows and whole texts.

Defined cases: a null or empty text has no windows and is scored as such; with no labelled rows of one of
both classes all scores are 0; a null doc_id counts as an empty string; labels other than 0 and 1 are
left out, and of contradicting labels 1 counts; repeated rows come out as often as they go in; an empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
TOXIC_ROWS = 1500
ORDINARY_ROWS = 4500
LONGEST = 20_000
SPLITS = 4

WINDOW_WORDS = 8
#: Windows overlap by half, so that any phrase of up to five words stands whole in one.
STRIDE = 4
WORD_BYTES = 48
CARRIER_BYTES = 64
MIN_MATCH = 4
#: With smaller ordinary dictionaries every window is compressed.
LEAST_ORDINARY = 4096
TOXIC_DICTIONARY = 4096
ORDINARY_DICTIONARY = 16384
GRAM = 5
RATIO = 20
#: A run or phrase counts if at least so many toxic documents hold it, and its log-likelihood ratio is at least so
#: high (24: by chance once in a million; a sample has some 100,000 units), whatever its size.
LEAST_ROWS = 4
SURPRISE = 24.0
#: Of one salient word or phrase so many occurrences at most are training text, so that none fills the dictionary alone.
SAME_SPAN = 20
#: Windows of ordinary rows that the ordinary dictionary is trained on at most, drawn from all of the sample's.
ORDINARY_WINDOWS = 50_000
#: Savings in bytes whose windows are counted.
SAVINGS = (2, 3, 4, 5, 6)
PUNCTUATION = b".,;:!?\"'()[]|*$%&#<>"


def words_of(text: str) -> list[bytes]:
    words = [w for w in (x.strip(PUNCTUATION) for x in text.encode("utf-8", "replace").lower().split()) if w]
    if max(map(len, words), default=0) <= WORD_BYTES:
        return words
    return [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]


def windows(words: list[bytes]) -> list[bytes]:
    """Windows from every STRIDE-th word on; the last one ends with the text."""
    return [b" ".join(words[i : i + WINDOW_WORDS]) for i in range(0, max(1, len(words) - WINDOW_WORDS + STRIDE), STRIDE) if words]


@dataclass(frozen=True)
class Model:
    """Contents of both dictionaries, and the calibration: mean, spread and weight of each feature, bias."""

    ordinary: bytes
    toxic: bytes
    means: np.ndarray
    spreads: np.ndarray
    weights: np.ndarray
    bias: float


class Savings:
    """Bytes that the toxic dictionary saves per window."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.plain, self.both = _compressor(ordinary), _compressor(toxic + ordinary)
        self.carrier = b" " + ordinary[-CARRIER_BYTES:]
        self.machine = _machine(telling(ordinary, toxic))

    def may_save(self, framed: bytes) -> bool:
        return self.machine is None or next(self.machine.iter(framed.decode("latin-1")), None) is not None

    def features(self, text: str) -> list[float]:
        """Number of windows, largest saving, and how many and what share of windows reach each saving."""
        plain, both, carrier = self.plain.compress, self.both.compress, self.carrier
        framed = [b" " + w + carrier for w in windows(words_of(text))]
        told = [w for w in framed if self.may_save(w)]
        found = Counter([len(plain(w)) - len(both(w)) for w in told])
        n = len(framed)
        if len(told) < n:
            found[0] += n - len(told)
        reached = [sum(c for saved, c in found.items() if saved >= least) for least in SAVINGS]
        shares = [np.log1p(1000.0 * c / max(1, n)) for c in reached]
        return [np.log1p(n), max(found, default=0), *np.log1p(reached).tolist(), *shares]


def telling(ordinary: bytes, toxic: bytes) -> set[bytes]:
    """Runs of bytes without any of which a window is as long with both dictionaries as with the ordinary one, so that it
    needn't be compressed; empty if that can't be said.

    These are, from each place of the toxic dictionary, the shortest run of at least MIN_MATCH bytes that the ordinary one does not
    have. A window without them has no match in the toxic dictionary that is longer than its longest in the ordinary
    one, which is nearer and searched first, and at the same distances as without the toxic one; the longer
    match wins, and the nearer one of two alike. One more run stands for a match that would go on backwards over the seam.
    """
    # Sizes by which the same search settings hold for both.
    if not toxic or len(ordinary) < LEAST_ORDINARY or _size_class(ordinary) != _size_class(toxic + ordinary):
        return set()
    both, seam = toxic + ordinary, len(toxic)
    runs = {both[seam - 1 : seam + MIN_MATCH]}
    for start in range(seam):
        n = MIN_MATCH
        while both[start : start + n] in ordinary:
            n += 1
        runs.add(both[start : start + n])
    return runs


def _size_class(content: bytes) -> int:
    """Of a dictionary and the short text that zstandard takes to come with it, to the next power of two."""
    return (len(content) + 512).bit_length()


def _machine(runs: set[bytes]):
    """An automaton that finds the runs in a text, a character for each byte; None if there are none."""
    import ahocorasick

    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for run in runs:
        machine.add_word(run.decode("latin-1"))
    machine.make_automaton()
    return machine if runs else None


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A strategy that looks at every place of a dictionary, so that lengths don't depend on where a word
    happens to stand in it."""
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=MIN_MATCH, window_log=17, hash_log=17, chain_log=17, search_log=5,
        write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    loaded = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    loaded.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=loaded, compression_params=settings)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_texts(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The sample: (text, label). Ids are chosen from narrow rows before any text is read."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    short = docs.filter(F.char_length("text") <= LONGEST).select("doc_id")
    known = known.join(short.distinct(), "doc_id")
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*first).limit(TOXIC_ROWS)
    chosen = chosen.unionByName(known.filter("toxic = 0").orderBy(*first).limit(ORDINARY_ROWS))
    # At most TOXIC_ROWS + ORDINARY_ROWS ids and labels are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.char_length("text") <= LONGEST)
    return sorted((r["text"], r["toxic"]) for r in rows.select("text", "toxic").collect())


def _grams(word: bytes) -> set[bytes]:
    padded = b" " + word + b" "
    return {padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)}


def _phrases(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return [*zip(words, words[1:]), *zip(words, words[1:], words[2:])]


def _surprise(toxic: int, ordinary: int, rows: list[int]) -> float:
    """Log-likelihood ratio (G) of a run that so many toxic and ordinary rows hold against even shares; rows
    are all ordinary and all toxic ones."""
    total, holding = sum(rows), toxic + ordinary
    cells = [(toxic, holding, rows[1]), (ordinary, holding, rows[0])]
    cells += [(rows[1] - toxic, total - holding, rows[1]), (rows[0] - ordinary, total - holding, rows[0])]
    return 2 * sum(n * log(n * total / (row * column)) for n, row, column in cells if n)


def _salient(toxic: list[set], ordinary: Iterable[set], n_ordinary: int) -> set:
    """Units of toxic texts that are far more frequent there; only units of enough toxic texts are counted in ordinary ones."""
    held = Counter(unit for units in toxic for unit in units)
    held = {unit: n for unit, n in held.items() if n >= LEAST_ROWS}
    plain = Counter(unit for units in ordinary for unit in units if unit in held)
    rows = [n_ordinary, len(toxic)]
    return {
        unit for unit, n in held.items()
        if (n + 0.5) / (rows[1] + 1) > RATIO * (plain[unit] + 0.5) / (rows[0] + 1) and _surprise(n, plain[unit], rows) >= SURPRISE
    }


def _without_copies(texts: list[list[bytes]]) -> list[list[bytes]]:
    seen: set = set()
    kept = []
    for words in texts:
        own = set(zip(words, words[1:], words[2:]))
        if 2 * len(own & seen) <= len(own):
            kept.append(words)
        seen |= own
    return kept


def _toxic_spans(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Salient words and phrases of toxic texts, as often as they occur but SAME_SPAN times at most."""
    different = _without_copies(toxic)

    def grams(words: list[bytes]) -> set:
        return {g for w in set(words) for g in _grams(w)}

    runs = _salient([grams(t) for t in different], map(grams, ordinary), len(ordinary))
    marked = {w for t in toxic for w in set(t) if not runs.isdisjoint(_grams(w))}

    def phrases(words: list[bytes]) -> set:
        return {p for p in _phrases(words) if marked.isdisjoint(p)}

    told = _salient([phrases(t) for t in different], map(phrases, ordinary), len(ordinary))
    spans = Counter(w for t in toxic for w in t if w in marked)
    spans.update(b" ".join(p) for t in toxic for p in _phrases(t) if p in told)
    return [span for span, n in sorted(spans.items()) for _ in range(min(n, SAME_SPAN))]


def _dictionary(spans: list[bytes], size: int, each: int) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    order = np.random.default_rng(1).permutation(len(spans))
    padded = [b" " + spans[i] + b" " for i in order]
    samples = [b"".join(padded[i : i + each]) for i in range(0, len(padded), each)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionaries(texts: list[tuple[list[bytes], int]]) -> tuple[bytes, bytes]:
    ordinary, toxic = [w for w, label in texts if not label], [w for w, label in texts if label]
    plain = [w for t in ordinary for w in windows(t)]
    if len(plain) > ORDINARY_WINDOWS:
        plain = [plain[i] for i in np.random.default_rng(0).choice(len(plain), ORDINARY_WINDOWS, replace=False)]
    return _dictionary(plain, ORDINARY_DICTIONARY, 1), _dictionary(_toxic_spans(toxic, ordinary), TOXIC_DICTIONARY, 4)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    return fit(training_texts(docs, labels))


def fit(texts: list[tuple[str, int]]) -> Model | None:
    """The model of labelled texts; equal texts with equal labels count once."""
    texts = sorted(set(texts))
    if {label for _, label in texts} != {0, 1}:
        return None
    # Parts by hash of the text, so that they don't depend on the order or number of the others.
    parts = np.array([crc32(text.encode("utf-8", "replace")) % SPLITS for text, _ in texts])
    split = [(words_of(text), label) for text, label in texts]
    x = np.zeros((len(texts), 2 + 2 * len(SAVINGS)))
    for part in range(SPLITS):
        savings = Savings(*_dictionaries([row for row, other in zip(split, parts) if other != part]))
        for i in np.flatnonzero(parts == part):
            x[i] = savings.features(texts[i][0])
    y = np.array([label for _, label in texts], float)
    means, spreads = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _logistic(np.column_stack([(x - means) / spreads, np.ones(len(x))]), y)
    plain, toxic = _dictionaries(split)
    return Model(plain, toxic, means, spreads, weights[:-1], float(weights[-1]))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights by Newton steps; the last column is the bias and isn't held down."""
    weights = np.zeros(x.shape[1])
    held = np.full(x.shape[1], penalty)
    held[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - held * weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def score(model: Model, savings: Savings, text: str) -> float:
    z = float((np.array(savings.features(text)) - model.means) / model.spreads @ model.weights + model.bias)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    model = train(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = Savings(model.ordinary, model.toxic) if model else None
        for batch in batches:
            scores = [score(model, savings, t or "") if model else 0.0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text")
        .mapInArrow(scored, f"doc_id {kind}, score double")
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
