"""Order MinHash sketches of texts and the alignment that verifies candidates, on word 5-grams.

A text is the sequence of its k-mers of five words (lower case, letters and digits), each labelled with
its occurrence number, so no symbol comes twice. One sketch entry takes the ``ell`` k-mers of smallest
hash and keeps them in text order. Two texts share an entry only if they share those k-mers in the same
order, which favours pairs within a small edit distance. A text of few k-mers also has an entry for all of
its k-mers but one, so that it meets every similar text that has at most ``ell`` of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import xxhash

#: Words of a k-mer, k-mers of an entry, entries of a sketch, least similarity.
K, ELL, ENTRIES, SIMILAR = 5, 5, 24, 0.8

_WORD = re.compile(r"\w+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Hashes held at a time while a sketch is made.
_BLOCK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return (x ^ (x >> np.uint64(29))) * _B


def word_codes(text: str) -> np.ndarray:
    """A 32-bit code of each word."""
    numbers: dict[str, int] = {}
    number = numbers.setdefault
    sequence = [number(w, len(numbers)) for w in _WORD.findall(text.lower())]
    codes = np.fromiter((xxhash.xxh32_intdigest(w) for w in numbers), np.uint32, len(numbers))
    return codes[sequence] if sequence else codes


def kmers(codes: np.ndarray) -> np.ndarray:
    """Occurrence-labelled k-mers in text order; one for a text of fewer words, none for no words."""
    words = codes.astype(np.uint64)
    size = min(K, len(words))
    if not size:
        return words
    out = np.zeros(len(words) - size + 1, np.uint64)
    for n in range(size):
        out = _mix(out + words[n:n + len(out)] + _A)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    if not new.all():
        at = np.arange(len(out))
        label = np.zeros(len(out), np.uint64)
        label[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        out = np.where(label > 0, _mix(out + label * _B), out)
    return out


def _folded(kept: np.ndarray, out: np.ndarray) -> np.ndarray:
    """A number for the k-mers of each row."""
    for n in range(kept.shape[1]):
        out = _mix(out + kept[:, n] + _A)
    return out


def sketch(grams: np.ndarray, ell: int = ELL, entries: int = ENTRIES) -> np.ndarray:
    """Distinct entries of the sketch as 64-bit numbers.

    A text of at most ``ell`` k-mers has one entry of all of them. A similar text has the same k-mers or one
    more, as ``ell`` of ``ell`` + 2 are too few; so a text of ``ell`` or ``ell`` + 1 k-mers has the entries
    that leave out one, too.
    """
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    if n <= ell:
        kept = grams[None, :]
    else:
        parts = []
        step = max(1, _BLOCK // n)
        for start in range(0, entries, step):
            seeds = _mix(np.arange(start + 1, min(entries, start + step) + 1, dtype=np.uint64) * _B)
            hashes = _mix(grams[None, :] ^ seeds[:, None])
            parts.append(np.sort(np.argpartition(hashes, ell, axis=1)[:, :ell], axis=1))
        kept = grams[np.concatenate(parts)]
    out = _folded(kept, np.zeros(len(kept), np.uint64) if n <= ell else np.arange(len(kept), dtype=np.uint64))
    if ell <= n <= ell + 1:
        without = np.array([np.delete(grams, i) for i in range(n)])
        out = np.append(out, _folded(without, np.zeros(n, np.uint64)))
    return np.unique(out).view(np.int64)


def aligned(left: np.ndarray, right: np.ndarray, least: float = SIMILAR) -> float:
    """Share of aligned k-mers: pairs in a common order over all k-mers of both texts.

    The longest common subsequence inside the band that texts of this similarity cannot leave. As no
    symbol repeats, it is the longest rising run of places, found in n log n steps.
    """
    a, b = len(left), len(right)
    if not a or not b:
        return 1.0 if a == b else 0.0
    # similarity s leaves at most (a + b)(1 − s)/(1 + s) k-mers unaligned
    band = int((a + b) * (1 - least) / (1 + least) + 1e-9)
    if abs(a - b) > band:
        return 0.0
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    if not near.any():
        return 0.0
    j = j[near][np.argsort(i[near])]
    if (np.diff(j) > 0).all():
        common = len(j)
    else:
        tails: list[int] = []
        for place in j.tolist():
            at = bisect_left(tails, place)
            if at == len(tails):
                tails.append(place)
            else:
                tails[at] = place
        common = len(tails)
    return common / (a + b - common)
