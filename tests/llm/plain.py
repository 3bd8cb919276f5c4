"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

import zstandard

from tickloom.llm.quality_rules import BAD_CHUNKS, CHUNK, CHUNK_BAND, DOCUMENT_BANDS, LEVEL

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text, size):
    words = SPACED.findall(low(text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near(docs, size, percent=80):
    """{id: (set size, component)}"""
    sets = {d: shingles(t, size) for d, t in docs}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: (len(sets[d]), root(d)) for d in ids}


def repeats(docs, size=13):
    """{id: (words, flags of removed words)}"""
    words = {d: SPACED.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out[d] = (w, gone)
    return out


def contamination(docs, items, size=10):
    """{id: (n_words, hit flags, item ids)}"""
    grams = {}
    for item, text in items:
        w = ALNUM.findall(low(text or ""))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for d, text in docs:
        w = ALNUM.findall(low(text or ""))
        hit, found = [False] * len(w), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (names := grams.get(tuple(w[i : i + n]))) is not None:
                    hit[i : i + n] = [True] * n
                    found |= {str(x) for x in names if x is not None}
        out[d] = (len(w), hit, sorted(found))
    return out


def rules(text):
    text = text or ""
    words = SPACED.findall(text)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {r for r, n in Counter(runs).items() if n > 1}
    hit = set()
    for i, r in enumerate(runs):
        if r in often:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    data = text.encode()
    pack = zstandard.ZstdCompressor(level=LEVEL)
    low_, high = [b[1:] for b in DOCUMENT_BANDS if len(data) >= b[0]][-1]
    good = bool(data) and low_ <= len(data) / len(pack.compress(data)) <= high
    full = len(data) // CHUNK
    bad = sum(
        not CHUNK_BAND[0] <= CHUNK / len(pack.compress(data[k * CHUNK : (k + 1) * CHUNK])) <= CHUNK_BAND[1]
        for k in range(full)
    )
    if bad and bad >= BAD_CHUNKS * full:
        good = False
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": failed,
        "kept": not failed and good,
    }


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
