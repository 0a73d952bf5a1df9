"""Plain versions of the contracts, written without the operators, and small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_fingerprint(text):
    words = SPACE.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """{doc_id: smallest doc_id reachable}, by comparing all pairs."""
    prints = {i: plain_fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def plain_substring_dedup(rows, window=13):
    words = {i: SPACE.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, own in words.items():
        gone = set()
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < i:
                gone.update(range(k, k + window))
        left = " ".join(w for k, w in enumerate(own) if k not in gone)
        out[i] = (len(own), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def plain_line_dedup(rows, run=3):
    lines = {i: [(n, x) for n, x in enumerate((t or "").split("\n")) if SPACE.search(x)] for i, t in rows}
    seen, gone = set(), {i: set() for i in lines}
    for i in sorted(lines):
        for k in range(len(lines[i]) - run + 1):
            key = tuple(x for _, x in lines[i][k : k + run])
            if key in seen:
                gone[i].update(n for n, _ in lines[i][k : k + run])
            seen.add(key)
    return {
        i: (len(lines[i]), len(gone[i]), "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i]))
        for i, t in rows
    }


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def plain_unigram(rows):
    tokens = {i: [*SPACE.findall(lower(t or "")), None] for i, t in rows}
    counts = Counter(x for i, own in tokens.items() if remainder(i, 7) != 2 for x in own)
    total, types = sum(counts.values()), len(counts)
    return {
        i: (len(own), sum(counts[x] > 0 for x in own), total,
            sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in own))
        for i, own in tokens.items()
    }


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain_licenses(text):
    words = WORD.findall(lower(text or ""))
    places = [
        (k, label) for phrase, label in PHRASES.items() for k in range(len(words))
        if words[k : k + len(phrase.split())] == phrase.split()
    ]
    starts = [k for k, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))
