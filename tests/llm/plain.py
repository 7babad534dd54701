"""Plain computations of what the operators must give, one text at a time."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text, least):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def covered(size):
        grams = collections.Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        return len({j for i in range(n - size + 1) if grams[tuple(words[i : i + size])] > 1 for j in range(i, i + size)})

    longest = 0
    for size in range(1, n):
        if len({tuple(words[i : i + size]) for i in range(n - size + 1)}) == n - size + 1:
            break
        longest = size
    signs = sum(c in "#*$%&|<>" for c in text)
    return [n, sum(map(len, words)), signs, len(lines) - len(set(lines)), covered(5), covered(least), longest]


def shingles(text, size=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def groups(rows, percent=85):
    """{doc_id: (set size, smallest id that links reach)}."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(rows, length=50):
    """{doc_id: (bytes, removed, runs, what is left)}."""
    first = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            first.setdefault(data[p : p + length], i)
    out = {}
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g))
    return out


def line_dedup(rows, ratio, pages):
    """{doc_id: text} of (doc_id, host, text)."""
    totals = collections.Counter(h for _, h, _ in rows if h is not None)
    seen = collections.Counter((h, x) for _, h, t in rows if t is not None for x in set(t.split("\n")) if x.strip(" "))

    def drop(host, line):
        n = seen[(host, line)]
        return host is not None and line.strip(" ") != "" and n >= pages and n > ratio * totals[host]

    return {i: None if t is None else "\n".join(x for x in t.split("\n") if not drop(h, x)) for i, h, t in rows}


def sha(data):
    return hashlib.sha256(data).hexdigest()
