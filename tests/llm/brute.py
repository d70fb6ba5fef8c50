"""Plain, slow versions of the operators' definitions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash
import zstandard

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def exact(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and whether it stays, by position."""
    groups = defaultdict(list)
    for at, (doc_id, text) in enumerate(rows):
        text = text or ""
        name = hashlib.sha256(re.sub(SPACE, "", text).encode()).hexdigest()
        groups[name].append((-len(text), doc_id is None, doc_id or 0, at, doc_id))
    out = {}
    for name, members in groups.items():
        best = min(members)
        for m in members:
            out[m[3]] = (m[4], best[4], len(members), name, m[3] == best[3])
    return [out[i] for i in range(len(rows))]


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(shingles))


def components(nodes, links):
    """Node -> smallest node reachable."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def near(rows):
    """(doc_id, fingerprint, component_id) of each row."""
    prints = [(doc_id, fingerprint(text)) for doc_id, text in rows]
    different = sorted({f for _, f in prints})
    close = [(a, b) for i, a in enumerate(different) for b in different[i + 1 :] if (a ^ b).bit_count() <= 4]
    roots = components(different, close)
    least = {}
    for doc_id, f in prints:
        if doc_id is not None:
            least[roots[f]] = min(doc_id, least.get(roots[f], doc_id))
    return [(doc_id, f, least.get(roots[f])) for doc_id, f in prints]


def mix(rows, key):
    """(size, source_size, target, repeats, words at or before the cut) of each (doc_id, source, text)."""
    sized = [(doc_id, source, len(re.findall(WORD, text or ""))) for doc_id, source, text in rows]
    sizes = Counter()
    for _, source, n in sized:
        sizes[source] += n
    named = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(named)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(named)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    taken = [0] * len(sized)
    rows_of = defaultdict(list)
    for i, r in enumerate(sized):
        rows_of[r[1]].append(i)
    for s in named:
        budget = int(target[s] + 1e-6)
        repeats = budget // sizes[s] if sizes[s] else 0
        rest = budget - repeats * sizes[s]
        places = defaultdict(list)
        for i in rows_of[s]:
            places[key(sized[i][0]), sized[i][0] is not None, sized[i][0] or 0, sized[i][2]].append(i)
        for place in sorted(places):
            alike, n = places[place], place[3]
            part = min(n, rest // len(alike))
            for i in alike:
                taken[i] = repeats * n + part
            rest = max(0, rest - n * len(alike))
    return [(n, sizes[s], target[s], taken[i]) for i, (_, s, n) in enumerate(sized)]


def toxicity(model, text):
    """The score by plain loops; a new compressor for each window."""
    options = dict(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=17, chain_log=17, search_log=5)
    options |= dict(write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    def length(window, content):
        settings = zstandard.ZstdCompressionParameters(**options)
        loaded = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        loaded.precompute_compress(compression_params=settings)
        return len(zstandard.ZstdCompressor(dict_data=loaded, compression_params=settings).compress(window))

    words = []
    for raw in re.findall(WORD.encode(), text.encode()):
        raw = raw.lower().strip(b".,;:!?\"'()[]|*$%&#<>")
        while raw:
            words.append(raw[:48])
            raw = raw[48:]
    saved, at = [], 0
    while words and (at == 0 or at + 4 < len(words)):
        framed = b" " + b" ".join(words[at : at + 8]) + b" " + model.ordinary[-64:]
        saved.append(length(framed, model.ordinary) - length(framed, model.toxic + model.ordinary))
        at += 4
    counts = [sum(s >= least for s in saved) for least in (2, 3, 4, 5, 6)]
    features = [math.log(1 + len(saved)), max(saved, default=0), *[math.log(1 + c) for c in counts]]
    features += [math.log(1 + 1000 * c / max(1, len(saved))) for c in counts]
    z = model.bias + sum(w * (f - m) / s for w, f, m, s in zip(model.weights, features, model.means, model.spreads))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed
    )


def private(text):
    """Base spans of personal data: (kind, start, end)."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            valid = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if valid:
                found.append((kind, m.start(), m.end()))
    return found
