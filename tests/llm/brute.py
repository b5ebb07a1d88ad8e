"""Plain versions of the contracts, written from their texts."""

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def base_quality(text):
    words = SPACED.findall(text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if SPACED.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base_licences(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words))
                    if words[i:i + len(p.split())] == p.split())
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({x[1] for x in places})))


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_pii(text):
    spans, counts = [], []
    for kind, pattern in KINDS.items():
        n = 0
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and _luhn(digits)
                    or kind == "phone" and 8 <= len(digits) <= 15)
            if fine:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
                n += 1
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


def ordered_similarity(left, right, k=5):
    """Share of aligned occurrence-labelled k-mers, by the quadratic table of common subsequences."""

    def grams(text):
        words = re.findall(r"\w+", text.lower())
        plain = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
        seen = Counter()
        out = []
        for g in plain:
            out.append((g, seen[g]))
            seen[g] += 1
        return out

    a, b = grams(left), grams(right)
    if not a or not b:
        return None
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def classes(ids, linked):
    """Connected classes of positions, as a label of each."""
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(ids))]


def merge_tokens(word, rank, end):
    """Byte-pair segmentation of a word in symbols, one merge at a time."""
    parts = [*word[:-1], word[-1] + end]
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not found:
            return parts
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
