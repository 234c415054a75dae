"""Plain versions of the training-data operators, for small tables in memory."""

import hashlib
import math
import re
import zlib

import numpy as np
import xxhash


def blank_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def lexical_words(text):
    folded = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def simhash(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in blank_words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(docs):
    """docs: (id, text) with distinct ids."""
    prints = {i: simhash(t) for i, t in docs}
    g = Groups(prints)
    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                g.join(a, b)
    return {i: ("%016x" % prints[i], g.find(i)) for i in ids}


def contamination(docs, items, window=13):
    windows = {}
    for name, text in items:
        w = lexical_words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(None if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w = lexical_words(text)
        hit, names = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    names |= found
                    hit[k : k + n] = [True] * n
        n_hit = sum(hit)
        out.append((i, len(w), n_hit, len(names), hashlib.sha256(",".join(sorted(n for n in names if n is not None)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(w)))
    return out


def removed(docs, window=13):
    """docs: (id, text); ids may be None or repeat."""
    first = {}
    split = [(i, blank_words(t)) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def near_vectors(rows, threshold=0.95):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    g, links = Groups(i for i, _ in rows if i is not None), dict.fromkeys((i for i, _ in rows if i is not None), 0)
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                g.join(a, b)
                links[a] += 1
                links[b] += 1
    return {i: (links[i], g.find(i)) for i in links}


def shards(rows, n=40):
    def draw(i, s):
        return -math.log((int(hashlib.md5(f"{'' if i is None else i}:{s}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48)

    out = []
    for i, text in rows:
        draws = [draw(i, s) for s in range(n + 1)]
        raw = (text or "").encode()
        out.append((i, len(raw) + 16, zlib.crc32(raw), draws.index(min(draws[:n])), draws.index(min(draws))))
    return out


def token_files(docs, encode):
    """docs sorted by id; encode gives the ids of a text."""
    out, start = [], 0
    for i, text in docs:
        ids = [*encode(text or ""), 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def license_places(text):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    w = lexical_words(text)
    found = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.encode().split()]
    starts = [k for k, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def clause(symbols):
    """(place, pattern) of the matches in a clause's symbols, by the rules."""
    near = lambda mark, k, n: mark in symbols[max(0, k - n) : k]
    out = []
    for k, x in enumerate(symbols):
        before = near("Y", k, 4)
        if x == "I" or x == "T" and (before or near("M", k, 3)):
            aimed = before or "Y" in symbols[k + 1 : k + 5]
            out.append((k, x + "a" * aimed + "n" * near("N", k, 3) + "r" * ("R" in symbols[:k])))
    return out


def toxicity(text, grammar, op):
    """(score, number of matches) of a text by a fitted grammar, word by word."""
    terms = [("I", t, w) for t, w in grammar.insults.items()] + [("T", t, 0.9) for t in op.THREATS]
    kinds = {**dict.fromkeys(op.INTENT, "M"), **dict.fromkeys(op.TARGETS, "Y"), **dict.fromkeys(op.NEGATION, "N"), **dict.fromkeys(op.REPORTING, "R")}
    clean, n = 1 - grammar.floor, 0
    for part in re.split(r"[.!?;:\n\r]+", (text or "").lower()):
        found = []
        for word in re.findall(r"[^\W_]+", part):
            fits = [(w, kind) for kind, t, w in terms if (word.startswith(t[:-1]) if t.endswith("*") else word == t)]
            w, kind = max(fits, default=(0.0, kinds.get(word, "o")))
            found.append((kind, w))
        for k, pattern in clause([x for x, _ in found]):
            clean *= 1 - found[k][1] * grammar.arcs[pattern]
            n += 1
    return 1 - clean, n


def license_verdict(text, phrases, texts, least=4, gap=12, share=0.4):
    """(labels, score) of a text, with (label, template) texts: longest matches found by trying all, best chains by all pairs."""
    w, base = lexical_words(text), license_places(text)[4]
    known = [lexical_words(p) for p in phrases] + [lexical_words(t) for _, t in texts]
    has = lambda part: any(part == k[i : i + len(part)] for k in known for i in range(len(k) - len(part) + 1))
    parts = {}
    for end in range(1, len(w) + 1):
        n = next((n for n in range(end, 0, -1) if has(w[end - n : end])), 0) if has(w[end - 1 : end]) else 0
        if n < least or end < len(w) and has(w[end - n : end + 1]):
            continue
        for t, (_, template) in enumerate(texts):
            k = lexical_words(template)
            parts.setdefault(t, []).extend((end - n, end, i, i + n) for i in range(len(k) - n + 1) if k[i : i + n] == w[end - n : end])
    best, labels = 0.0, {x for x in base.split(",") if x}
    for t, found in parts.items():
        covered = [0]
        for b, e, tb, te in found:
            joined = [c + e - b - max(0, pe - b, pt - tb) for c, (_, pe, _, pt) in zip(covered[1:], found, strict=False) if pe < e and pt < te and b - pe <= gap and tb - pt <= gap]
            covered.append(max([e - b, *joined]))
        size = len(lexical_words(texts[t][1]))
        if max(covered) >= share * size:
            labels.add(texts[t][0])
            best = max(best, min(1.0, max(covered) / size))
    return ",".join(sorted(labels)), 1 - (1 - best) * (0.4 if base else 1.0)
