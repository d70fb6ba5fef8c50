"""SentencePiece encoding and decoding: distinct segmentations sampled by Gumbel top-k.

A text's segmentations into pieces of the vocabulary are the paths of a lattice. Messages from the end
of the lattice give each piece its probability given where it starts, so the choice of pieces from left
to right is a tree whose leaves are segmentations, with their exact probabilities. Top-k search of that tree
under Gumbel noise is a best-first (A-star) search: a set of unopened siblings stands on the frontier with the largest
perturbed log probability of anything below it, drawn below the value of what it branches off; the
best of the frontier is opened until it is a leaf. That gives k different segmentations, a sample without replacement.
``log_inclusion`` is the log probability that a segmentation's noise would lift it over the best one left out.

No piece crosses the start of a word, so the lattice of a text is the product of its words' lattices; those of the words
used most are kept, up to a bound. All noise is a hash of the row's key, the rank and the
place in the text: a row's result does not depend on its neighbours or on which task runs it.

The model's scores are merge ranks; a piece of rank r has a weight of 1 / (r + 1), to the power ALPHA.
Characters that are no piece are their UTF-8 bytes' pieces. Decoding gives back the text, exactly.

Defined cases: a null or empty text has one segmentation, without pieces; a text with fewer than k
segmentations has as many rows as it has segmentations; a null doc_id is a key of its own; repeated rows
come out as often as they go in, alike; an empty table gives no rows. Only the columns named are read. Memory
grows with the longest text, not with the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SEED = 1
ALPHA = 1.0
#: Code points that are worked through at once, at least one text.
SLICE = 1 << 17
#: Nodes (about characters) of the words whose lattices a task keeps; some 100 bytes each.
STORE = 1 << 19

_WORDS = re.compile(r" *[^ \n]+| +|\n+")
#: Ranks of pieces that the model lists without a usable score.
_NO_RANK = -1e8


class Vocabulary:
    """Pieces as a trie over classes of characters, with log weights."""

    def __init__(self, model: bytes, alpha: float = ALPHA) -> None:
        loaded = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = loaded.get_piece_size()
        ranks = np.array([-loaded.get_score(i) if loaded.get_score(i) > _NO_RANK else n for i in range(n)])
        logs = -alpha * np.log(np.maximum(ranks, 0) + 1)
        self.logs = logs - np.logaddexp.reduce(logs)
        self.surface: list[bytes] = [b""] * n
        self.byte_ids = np.full(256, -1, np.int64)
        spelled: dict[str, int] = {}
        for i in range(n):
            if loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i):
                continue
            piece = loaded.id_to_piece(i)
            if loaded.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.surface[i] = i, bytes([value])
            else:
                text = piece.replace("▁", " ")
                if " " in text.lstrip(" ") or (text.startswith("  ") and text.strip(" ")) or "\n" in text:
                    raise ValueError(f"piece {i} crosses the start of a word")
                spelled[text], self.surface[i] = i, text.encode()
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no piece for some bytes")
        #: The first code point of each piece, the second and so on, filled up with zeros.
        self.n_points = np.zeros(n, np.int64)
        self.points = np.zeros((max(map(len, spelled)), n), np.uint32)
        for text, i in spelled.items():
            self.n_points[i] = len(text)
            self.points[: len(text), i] = [ord(c) for c in text]
        chars = sorted({c for text in spelled for c in text})
        self.classes = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        nodes: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        for text, i in spelled.items():
            state = 0
            for c in text:
                state = nodes.setdefault((state, c), len(nodes) + 1)
            ends[state] = i
        keys = np.fromiter((s * self.width + self.classes[ord(c)] for s, c in nodes), np.int64, len(nodes))
        self._place(keys, np.fromiter(nodes.values(), np.int64, len(nodes)))
        self.first = np.zeros(self.width, np.int64)
        for (state, c), target in nodes.items():
            if state == 0:
                self.first[self.classes[ord(c)]] = target
        self.piece_at = np.full(len(nodes) + 1, -1, np.int64)
        self.piece_at[list(ends)] = list(ends.values())

    def _place(self, keys: np.ndarray, targets: np.ndarray) -> None:
        """Transitions in a hash table with linear probing, at most a quarter full; free slots hold -1."""
        self.shift = np.uint64(64 - max(3, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.targets = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.targets[slots[placed]] = targets[placed]
            keys, targets, slots = keys[~placed], targets[~placed], (slots[~placed] + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def follow(self, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which transitions there are, and where these lead."""
        if not states.any():
            there = self.first[classes] > 0
            return there, self.first[classes[there]]
        wanted = states * self.width + classes
        at = self._slots(wanted)
        left = np.arange(len(wanted))
        while len(left):
            held = self.keys[at[left]]
            left = left[(held != wanted[left]) & (held >= 0)]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        there = (self.keys[at] == wanted) & (classes > 0)
        return there, self.targets[at[there]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; the space that encoding puts before a text is taken away."""
        return b"".join(map(self.surface.__getitem__, ids.tolist()))[1:]


class Lattice:
    """The lattices of different words, laid end to end; a node is a place between characters."""

    def __init__(self, words: list[str], vocabulary: Vocabulary) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1  # one node after each word's last character
        self.starts = ends - lengths
        n = int(ends[-1]) + 1
        codes = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        codes[inside] = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4")
        classes = vocabulary.classes[codes].astype(np.int64)
        classes[ends] = 0
        origin = at = np.flatnonzero(inside)
        states, depth = np.zeros(len(at), np.int64), 0
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        count = np.zeros(n, np.int64)
        while len(at):
            there, states = vocabulary.follow(states, classes[at])
            at, origin, depth = at[there] + 1, origin[there], depth + 1
            pieces = vocabulary.piece_at[states]
            whole = pieces >= 0
            found.append((origin[whole], pieces[whole], depth))
            count[origin[whole]] += 1
            if depth == 1:
                spelled = np.flatnonzero(inside & (count == 0))  # characters that are no piece: their bytes
                found.append((spelled, np.full(len(spelled), -1), 1))
                count[spelled] += 1
        # Edges by where they start, the longest first; a length occurs once at each place.
        self.first_edge = np.concatenate(([0], np.cumsum(count)))
        slot = self.first_edge[:-1].copy()
        self.source = np.repeat(np.arange(n), count)
        self.target, placed = np.empty_like(self.source), np.empty_like(self.source)
        for start, piece, length in reversed(found):
            edges = slot[start]
            slot[start] += 1
            self.target[edges], placed[edges] = start + length, piece
        self._spell(placed, codes, vocabulary)
        self._weigh(np.repeat(ends, lengths + 1), n)
        self.inside = inside

    def _spell(self, pieces: np.ndarray, codes: np.ndarray, vocabulary: Vocabulary) -> None:
        """The ids of each edge, and its log weight."""
        bare = np.flatnonzero(pieces < 0)
        spellings = [vocabulary.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in codes[self.source[bare]].tolist()]
        self.n_ids = np.ones(len(pieces), np.int64)
        self.n_ids[bare] = [len(s) for s in spellings]
        self.id_at = np.cumsum(self.n_ids) - self.n_ids
        self.ids = np.repeat(pieces, self.n_ids)
        self.weight = vocabulary.logs[pieces]
        # Whether the ids say what the text has there.
        whole = np.flatnonzero(pieces >= 0)
        self.spelled = np.zeros(len(pieces), bool)
        self.spelled[whole] = vocabulary.n_points[pieces[whole]] == self.target[whole] - self.source[whole]
        left = whole[self.spelled[whole]]
        spelling, starts, points = pieces[left], self.source[left], vocabulary.n_points[pieces[left]]
        for at, column in enumerate(vocabulary.points):
            if at:
                longer = np.flatnonzero(points > at)
                left, spelling, starts, points = left[longer], spelling[longer], starts[longer], points[longer]
            if not len(left):
                break
            self.spelled[left[column[spelling] != codes[starts + at]]] = False
        for e, spelling in zip(bare.tolist(), spellings, strict=True):
            self.ids[self.id_at[e] : self.id_at[e] + len(spelling)] = spelling
            self.weight[e] = vocabulary.logs[spelling].sum()
            said = b"".join(vocabulary.surface[i] for i in spelling)
            self.spelled[e] = said == chr(codes[self.source[e]]).encode("utf-8", "replace")

    def _weigh(self, end_of: np.ndarray, n: int) -> None:
        """Messages from the end of each word, and each edge's probability given where it starts."""
        message = np.zeros(n)
        distance = (end_of - np.arange(n))[self.source]
        small = distance.astype(np.uint16) if len(distance) == 0 or distance.max() < 1 << 16 else distance
        order = np.argsort(small, kind="stable")
        cuts = np.flatnonzero(np.diff(distance[order], prepend=-1, append=np.iinfo(np.int64).max))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            edges = order[a:b]
            sources = self.source[edges]
            heads = np.flatnonzero(np.diff(sources, prepend=-1))
            message[sources[heads]] = np.logaddexp.reduceat(self.weight[edges] + message[self.target[edges]], heads)
        self.log_share = self.weight + message[self.target] - message[self.source]
        self.share = np.exp(self.log_share)
        # Summed place by place, so that it doesn't depend on what else is in the lattice.
        self.reach = self.share.copy()
        counts = np.diff(self.first_edge)
        some = np.flatnonzero(counts > 1)
        for k in range(1, int(counts.max(initial=0))):
            some = some[counts[some] > k]
            edges = self.first_edge[some] + k
            self.reach[edges] += self.reach[edges - 1]
        self.reach[self.first_edge[1:][counts > 0] - 1] = 1.0  # each place's last edge


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.held, self.n = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.empty(max(n, len(self.held) * 5 // 4) - self.n, self.held.dtype)])
        self.held[self.n : n] = values
        self.n = n

    def __call__(self) -> np.ndarray:
        return self.held[: self.n]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of them, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Lattices:
    """The lattice of words seen so far, so that a word is mostly worked out once in a task. When it has more than STORE nodes, those
    words stay that were used most, of up to half as many nodes, which bounds its memory."""

    inside: np.ndarray
    source: np.ndarray
    target: np.ndarray
    first_edge: np.ndarray
    n_ids: np.ndarray
    id_at: np.ndarray
    ids: np.ndarray
    spelled: np.ndarray
    log_share: np.ndarray
    reach: np.ndarray
    KINDS = {
        "inside": bool, "source": np.int32, "target": np.int32, "first_edge": np.int64, "n_ids": np.int8, "id_at": np.int32,
        "ids": np.int32, "spelled": bool, "log_share": np.float64, "reach": np.float64,
    }

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.starts = _Grown(np.int64)
        self.held = {name: _Grown(kind) for name, kind in self.KINDS.items()}
        self._clear()

    def _clear(self) -> None:
        """The arrays keep their room, so that they needn't grow again."""
        self.numbers = _Numbers()
        self.used = np.zeros(0, np.int64)
        for grown in (self.starts, *self.held.values()):
            grown.n = 0
        self.held["first_edge"].add(np.zeros(1, np.int64))

    def forget(self) -> None:
        """Between slices only, as places in the lattice change."""
        if self.held["inside"].n > STORE:
            self._keep_most_used(STORE // 2)

    def use(self, numbers: np.ndarray) -> None:
        """Counts the uses of words, by number."""
        counts = np.bincount(numbers, minlength=len(self.numbers))
        counts[: len(self.used)] += self.used
        self.used = counts

    def _keep_most_used(self, nodes: int) -> None:
        held = {name: grown() for name, grown in self.held.items()}
        starts, used, words = self.starts(), self.used, list(self.numbers)
        lengths = np.diff(starts, append=len(held["inside"]))
        order = np.argsort(-used, kind="stable")
        most = order[np.cumsum(lengths[order]) <= nodes]
        kept = np.sort(most[used[most] > 1])
        starts, lengths = starts[kept], lengths[kept]
        first, last = held["first_edge"][starts], held["first_edge"][starts + lengths]
        ends = np.append(held["id_at"], len(held["ids"]))
        at_nodes, at_edges, at_ids = _ranges(starts, lengths), _ranges(first, last - first), _ranges(ends[first], ends[last] - ends[first])
        new_starts = np.cumsum(lengths) - lengths
        moved = np.repeat(new_starts - starts, last - first)
        new = {name: held[name][at_edges] for name in ("source", "target", "n_ids", "spelled", "log_share", "reach")}
        new["source"], new["target"] = new["source"] + moved, new["target"] + moved
        new["first_edge"] = np.cumsum((held["first_edge"][1:] - held["first_edge"][:-1])[at_nodes])
        new["id_at"] = np.cumsum(new["n_ids"], dtype=np.int64) - new["n_ids"]
        new["inside"], new["ids"] = held["inside"][at_nodes], held["ids"][at_ids]
        self._clear()
        self.starts.add(new_starts)
        for name, values in new.items():
            self.held[name].add(values)
        self.numbers.update((words[w], i) for i, w in enumerate(kept.tolist()))
        self.used = used[kept] // 2  # so that words of long ago go in the end

    def add_new(self) -> None:
        """Works out the words that were numbered since the last call; then all arrays can be read."""
        new = list(islice(self.numbers, self.starts.n, None))
        if new:
            part = Lattice(new, self.vocabulary)
            moved = {"source": "inside", "target": "inside", "first_edge": "source", "id_at": "ids"}
            offsets = {name: self.held[of].n for name, of in moved.items()}
            self.starts.add(part.starts + self.held["inside"].n)
            for name, grown in self.held.items():
                values = getattr(part, name)[1:] if name == "first_edge" else getattr(part, name)
                grown.add(values + offsets[name] if name in offsets else values)
        for name, grown in self.held.items():
            setattr(self, name, grown())

    def choose(self, nodes: np.ndarray, noise: np.ndarray) -> np.ndarray:
        """An edge from each node, by its probability."""
        edges = self.first_edge[nodes]
        short = np.flatnonzero(noise > self.reach[edges])
        while len(short):
            edges[short] += 1
            short = short[noise[short] > self.reach[edges[short]]]
        return edges


class _Numbers(dict):
    """A number for each different word."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


_WORD_STEP, _STEP_STEP, _USE_STEP = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))


def _noise(keys: np.ndarray, words: np.ndarray, step: np.ndarray | int, use: int) -> np.ndarray:
    """Numbers between 0 and 1, a hash of row key, place and use."""
    x = words.astype(np.uint64)
    x *= _WORD_STEP
    x += keys
    if np.ndim(step):
        x += step.astype(np.uint64) * _STEP_STEP
        x += np.uint64(use * int(_USE_STEP) % (1 << 64))
    else:
        x += np.uint64((int(step) * int(_STEP_STEP) + use * int(_USE_STEP)) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    found = x.astype(np.float64)
    found *= 2.0**-53
    found += 2.0**-54
    return found


def _below(most: np.ndarray | float, log_mass: np.ndarray | float, noise: np.ndarray | float) -> np.ndarray:
    """The largest Gumbel-perturbed value of a mass, given that it is below ``most``."""
    with np.errstate(divide="ignore", over="ignore"):
        return -np.logaddexp(-np.asarray(most), np.log(-np.log(noise)) - log_mass)


class Path:
    """One segmentation of each text of a slice: its edges, and the frontier along it."""

    def __init__(self, texts: np.ndarray, words: np.ndarray, edges: np.ndarray, n_texts: int) -> None:
        self.texts, self.words, self.edges = texts, words, edges
        self.bounds = np.searchsorted(texts, np.arange(n_texts + 1))


class Sampler:
    def __init__(self, vocabulary: Vocabulary, samples: int) -> None:
        self.vocabulary, self.samples = vocabulary, samples
        self.lattices = Lattices(vocabulary)

    def _walk(self, lattice: Lattices, keys: np.ndarray, texts: np.ndarray, words: np.ndarray, nodes: np.ndarray, use: int) -> tuple:
        """Edges from the given nodes to the ends of their words: (text, word, edge), in order."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        at, places, step = nodes, np.arange(len(nodes)), 0
        lengths = np.zeros(len(nodes), np.int64)
        on = lattice.inside[at]
        while True:
            at, places = at[on], places[on]
            if not len(at):
                break
            # A node stands for its place in the word, so a walk from a later node draws other noise.
            edges = lattice.first_edge[at]
            several = np.flatnonzero(lattice.first_edge[at + 1] - edges > 1)
            of = places[several]
            edges[several] = lattice.choose(at[several], _noise(keys[texts[of]], words[of], step, use))
            parts.append((places, edges))
            lengths[places] += 1
            at, step = lattice.target[edges], step + 1
            on = lattice.inside[at]
        offsets = np.cumsum(lengths) - lengths
        edges = np.empty(int(lengths.sum()), np.int64)
        for step, (places, found) in enumerate(parts):
            edges[offsets[places] + step] = found
        who = np.repeat(np.arange(len(nodes)), lengths)
        return texts[who], words[who], edges

    def sample(self, texts: list[str], keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
        """(text, rank, ids, log_prob, perturbed, log_inclusion), by text and rank."""
        for *row, _ in self.checked(texts, keys):
            yield tuple(row)

    def checked(self, texts: list[str], keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, float, float, float, bool]]:
        """sample, and whether the ids spell the text, edge by edge."""
        n = len(texts)
        lattice = self.lattices
        lattice.forget()
        numbers = lattice.numbers
        lengths = np.zeros(n, np.int64)
        listed: list[int] = []
        for i, text in enumerate(texts):
            if text:
                words = _WORDS.findall(" " + text)
                listed += itemgetter(*words)(numbers) if len(words) > 1 else [numbers[words[0]]]
                lengths[i] = len(words)
        if not listed:
            for i in range(n):
                yield i, 1, np.zeros(0, np.int64), 0.0, 0.0, 0.0, True
            return
        lattice.add_new()
        of_text = np.repeat(np.arange(n), lengths)
        in_text = np.arange(len(of_text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        listed = np.array(listed, np.int64)
        lattice.use(listed)
        starts = lattice.starts()[listed]
        first_word = np.cumsum(lengths) - lengths
        best = -np.log(-np.log(_noise(keys, np.zeros(n, np.int64), 0, 1)))
        path = Path(*self._walk(lattice, keys, of_text, in_text, starts, 2), n)
        taken = [self._measured(lattice, keys, path, best, np.zeros(n, np.int64), 3)]
        opened: dict[tuple[int, int, int], list[int]] = {}
        for rank in range(1, self.samples):
            taken.append(self._next(lattice, keys, taken, opened, rank, n, starts, first_word, lengths, in_text, of_text))
        spelt = [self._spelt(lattice, t["path"], n, starts, first_word, lengths) for t in taken]
        yield from self._rows(lattice, taken, spelt, n)

    def _spelt(self, lattice: Lattices, path: Path, n: int, starts: np.ndarray, first_word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per text, whether the path's edges say what the text has, each goes on where the one before ended, and they go from the
        first word's start to the last one's end."""
        if not len(path.edges):
            return lengths == 0
        source, target, word = lattice.source[path.edges], lattice.target[path.edges], first_word[path.texts] + path.words
        fresh = np.ones(len(word), bool)
        fresh[1:] = word[1:] != word[:-1]
        good = lattice.spelled[path.edges] & np.where(fresh, source == starts[word], True)
        good[1:] &= np.where(fresh[1:], (path.words[1:] == 0) | (word[1:] == word[:-1] + 1), source[1:] == target[:-1])
        last = np.append(fresh[1:], True)
        good &= ~last | ~lattice.inside[target]
        spelt = np.bincount(path.texts[~good], minlength=n) == 0
        counted = np.bincount(path.texts[fresh], minlength=n)
        return spelt & (counted == lengths)

    def _measured(self, lattice: Lattices, keys: np.ndarray, path: Path, best: np.ndarray, fresh: np.ndarray, use: int) -> dict:
        """A path with its log probability and frontier. Steps before ``fresh`` (per text) are not its own."""
        logs = lattice.log_share[path.edges]
        total = np.cumsum(logs)
        start = np.concatenate(([0.0], total))[path.bounds[:-1]]
        before = total - logs - start[path.texts]
        source = lattice.source[path.edges]
        place = np.arange(len(path.edges)) - path.bounds[:-1][path.texts]
        # Where there was a choice, after what the path shares with the one it branched off.
        own = np.flatnonzero((lattice.first_edge[source + 1] - lattice.first_edge[source] > 1) & (place >= fresh[path.texts]))
        of = path.texts[own]
        with np.errstate(divide="ignore"):
            rest = before[own] + np.log(np.maximum(0.0, -np.expm1(np.minimum(logs[own], 0.0))))
        frontier = np.full(len(path.edges), -np.inf)
        frontier[own] = _below(best[of], rest, _noise(keys[of], path.words[own], place[own], use))
        ended = np.concatenate(([0.0], total))[path.bounds[1:]] - start
        return {"path": path, "best": best, "log_prob": ended, "before": before, "frontier": frontier}

    def _largest(self, taken: list[dict], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, ranks, steps) of each text's best set of unopened siblings; minus infinity if there is none."""
        value, rank, step = np.full(n, -np.inf), np.full(n, -1), np.full(n, -1)
        for r, t in enumerate(taken):
            path, frontier = t["path"], t["frontier"]
            some = np.flatnonzero(np.diff(path.bounds))
            if not len(some):
                continue
            most = np.maximum.reduceat(frontier, path.bounds[some])
            at = np.flatnonzero(frontier == np.repeat(most, np.diff(path.bounds)[some]))
            first = at[np.searchsorted(at, path.bounds[some])] - path.bounds[some]
            # Of equal values the later path's goes first.
            better = (most >= value[some]) & (most > -np.inf)
            chosen = some[better]
            value[chosen], rank[chosen], step[chosen] = most[better], r, first[better]
        return value, rank, step

    def _next(self, lattice, keys, taken, opened, rank, n, starts, first_word, lengths, in_text, of_text) -> dict:
        """Opens the best of each text's frontier and walks on from there to the end of the text."""
        best, fresh = np.full(n, -np.inf), np.zeros(n, np.int64)
        kept: list[np.ndarray] = []  # steps shared with the path branched off, and the sibling opened
        kept_texts, kept_words = [], []
        mid_nodes, mid_texts, mid_words = [], [], []
        later = np.zeros(len(starts), bool)
        draws = _noise(keys, np.zeros(n, np.int64), 1, 8 * rank)
        values, ranks, steps = self._largest(taken, n)
        for i in np.flatnonzero(values > -np.inf).tolist():
            value, r, step = float(values[i]), int(ranks[i]), int(steps[i])
            old = taken[r]
            path: Path = old["path"]
            a = int(path.bounds[i])
            edge, word = int(path.edges[a + step]), int(path.words[a + step])
            node = int(lattice.source[edge])
            gone = opened.setdefault((i, r, step), [edge])
            siblings = [e for e in range(int(lattice.first_edge[node]), int(lattice.first_edge[node + 1])) if e not in gone]
            shares = np.cumsum(np.exp(lattice.log_share[siblings]))
            picked = siblings[min(int(np.searchsorted(shares, draws[i] * shares[-1], side="right")), len(siblings) - 1)]
            gone.append(picked)
            left = float(shares[-1] - np.exp(lattice.log_share[picked])) if len(siblings) > 1 else 0.0
            before = float(old["before"][a + step])
            again = _noise(keys[i : i + 1], np.array([word]), step, 8 * rank + 1)[0]
            old["frontier"][a + step] = _below(value, before + np.log(left), again) if left > 0 else -np.inf
            best[i], fresh[i] = value, step + 1
            kept.append(np.append(path.edges[a : a + step], picked))
            kept_texts.append(np.full(step + 1, i))
            kept_words.append(path.words[a : a + step + 1])
            mid_nodes.append(int(lattice.target[picked]))
            mid_texts.append(i)
            mid_words.append(word)
            later[first_word[i] + word + 1 : first_word[i] + lengths[i]] = True
        texts = np.concatenate([np.array(mid_texts, np.int64), of_text[later]])
        words = np.concatenate([np.array(mid_words, np.int64), in_text[later]])
        nodes = np.concatenate([np.array(mid_nodes, np.int64), starts[later]])
        walked = self._walk(lattice, keys, texts, words, nodes, 8 * rank + 2)
        all_texts, all_words, all_edges = (
            np.concatenate([*a, b]).astype(np.int64) for a, b in zip((kept_texts, kept_words, kept), walked, strict=True)
        )
        # By text; what was kept comes first, then words from the one branched in to the last.
        order = np.argsort(all_texts, kind="stable")
        path = Path(all_texts[order], all_words[order], all_edges[order], n)
        return self._measured(lattice, keys, path, best, fresh, 8 * rank + 3)

    def _rows(self, lattice: Lattices, taken: list[dict], spelt: list[np.ndarray], n: int) -> Iterator[tuple]:
        ids = [self._ids(lattice, t["path"]) for t in taken]
        outside, _, _ = self._largest(taken, n)
        for i in range(n):
            out = float(outside[i])
            for r, t in enumerate(taken):
                if t["best"][i] == -np.inf:
                    break
                flat, bounds = ids[r]
                log_prob = float(t["log_prob"][i])
                lifted = log_prob - out
                log_inclusion = 0.0 if out == -np.inf else lifted if lifted < -30 else float(np.log(-np.expm1(-np.exp(lifted))))
                numbers = (round(x, 6) for x in (log_prob, float(t["best"][i]), log_inclusion))
                yield i, r + 1, flat[bounds[i] : bounds[i + 1]], *numbers, bool(spelt[r][i])

    def _ids(self, lattice: Lattices, path: Path) -> tuple[np.ndarray, np.ndarray]:
        counts = lattice.n_ids[path.edges]
        ends = np.cumsum(counts)
        places = np.repeat(lattice.id_at[path.edges] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        return lattice.ids[places], np.concatenate(([0], ends))[path.bounds]


def row_keys(ids: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), seed) for i in ids], np.uint64)


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > SLICE:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def segmentations(docs: DataFrame, keep: list[str], samples: int = SAMPLES, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """(keep..., rank, n_pieces, log_prob, perturbed, log_inclusion, ids, decodes), up to ``samples`` rows per
    document. ids are 32-bit little-endian integers end to end; decodes says that they give back the text."""
    with open(model, "rb") as file:
        proto = file.read()
    fields = "rank INT, n_pieces BIGINT, log_prob DOUBLE, perturbed DOUBLE, log_inclusion DOUBLE, ids BINARY, decodes BOOLEAN"
    schema = StructType([*docs.select(*keep).schema, *StructType.fromDDL(fields)])
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.bool_()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(proto)
        sampler = Sampler(vocabulary, samples)
        for batch in batches:
            texts = batch.column(1)
            keys = row_keys(batch.column(0).to_pylist(), seed)
            for a, b in _slices(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                part = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                rows, places = [], []
                for i, rank, ids, *numbers, spelt in sampler.checked(part, keys[a:b]):
                    places.append(a + i)
                    rows.append((rank, len(ids), *numbers, ids.astype("<i4", copy=False).tobytes(), spelt))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                kept = [c.take(pa.array(places, pa.int64())) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*kept, *columns], schema.fieldNames())

    return docs.select("doc_id", "text", *keep).mapInArrow(encode, schema)


def decoded(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(ids) as made by segmentations -> (ids, text)."""
    with open(model, "rb") as file:
        proto = file.read()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(proto)
        for batch in batches:
            texts = [vocabulary.decode(np.frombuffer(ids or b"", "<i4")).decode("utf-8", "replace") for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["ids", "text"])

    return encoded.select("ids").mapInArrow(decode, "ids binary, text string")
