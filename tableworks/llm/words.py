"""Exact tokens of whole texts through memos of white-space pieces and of words.

The ``word_bpe`` tokenizer drops white space and never looks across it, so the tokens of a text are
those of its pieces in order, and the tokens of a piece those of its words (runs of letters, single
digits, runs of other signs). Both are looked up once and remembered; a memo is emptied when it is
full and when the worker turns to another stage, which changes nothing but the time.
"""

from __future__ import annotations

import functools
import re

import numpy as np

from tableworks.llm.batches import kept_for_a_stage

#: Entries of a memo and the longest piece kept: together at most about 250 MB for each Python worker.
MEMO, LONGEST = 600_000, 40

#: Characters whose normal form, lower case and class are the same in every Unicode version.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def library(path: str):
    """The tokenizer as its library loads it; one for each Python worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def specials(path: str) -> dict[str, int]:
    """Strings that the library takes as tokens of their own, with their ids."""
    return {t.content: n for n, t in library(path).get_added_tokens_decoder().items()}


@functools.cache
def byte_symbols() -> list[str]:
    """The printable symbol that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = dict(zip(shown, map(chr, shown))) | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


def words_of(text: str, path: str) -> list[str]:
    """The words of a piece, normalised, in byte-level symbols."""
    if _PLAIN.fullmatch(text):
        names = byte_symbols()
        return [w if w.isascii() else "".join([names[b] for b in w.encode()]) for w in _WORDS.findall(text.lower())]
    own = library(path)
    return [w for w, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))]


class Pieces:
    """What ``of_word`` and ``of_special`` say of each word, added up over white-space pieces."""

    def __init__(self, path: str, of_word, of_special, empty):
        self.path, self.of_word, self.of_special, self.empty = path, of_word, of_special, empty
        self._cut = re.compile("(" + "|".join(map(re.escape, specials(path))) + ")") if specials(path) else None
        self.words: dict = {}
        self.pieces: dict = {}

    def _word(self, word: str):
        if (known := self.words.get(word)) is None:
            known = self.of_word(word)
            if len(word) <= LONGEST:
                if len(self.words) >= MEMO:
                    self.words.clear()
                self.words[word] = known
        return known

    def _piece(self, text: str):
        total = self.empty
        if "<|" in text and self._cut and self._cut.search(text):
            for n, part in enumerate(self._cut.split(text)):
                total = total + (self.of_special(part) if n % 2 else self._piece(part) if part else self.empty)
            return total
        for word in words_of(text, self.path):
            total = total + self._word(word)
        return total

    def look_up(self, pieces: list[bytes]) -> list:
        """The value of each piece."""
        memo = self.pieces
        found = list(map(memo.get, pieces))
        if None in found:
            if len(memo) >= MEMO:
                memo.clear()
            for n, piece in enumerate(pieces):
                if found[n] is None:
                    value = memo.get(piece)
                    if value is None:
                        value = self._piece(piece.decode())
                        if len(piece) <= LONGEST:
                            memo[piece] = value
                    found[n] = value
        return found


@functools.cache
def word_ids(path: str) -> Pieces:
    """Token ids as little-endian unsigned 32-bit bytes; one memo for each Python worker and stage."""
    tokenize = library(path).model.tokenize

    def ids(word: str) -> bytes:
        return np.array([t.id for t in tokenize(word)], "<u4").tobytes()

    return Pieces(path, ids, lambda s: np.array([specials(path)[s]], "<u4").tobytes(), b"")


kept_for_a_stage(word_ids.cache_clear)


def encode(path: str, text: bytes) -> bytes:
    """Ids of a whole text in UTF-8 as the library gives them, without added tokens."""
    return b"".join(word_ids(path).look_up(text.split()))
