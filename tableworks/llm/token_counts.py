"""Token counts by a transducer compiled from the merges of a vocabulary.

The states are those of the automaton of all tokens; a transition reads one symbol of a word and is
annotated with the tokens that can end there, longest first. Which of them does is settled by the token
before it, so each transition emits the change in the number of tokens so far (merging symbols may
lower it). Whole words and white-space pieces become arcs of their own when they are first met; these
tables can be dropped at any time.

A long text is cut into chunks of bytes. A chunk maps the unfinished word it is entered with to the
tokens of the words it ends and the unfinished word it leaves; these maps compose associatively and are
combined by a prefix scan in log-many rounds.
"""

from __future__ import annotations

import functools
import json

import pyarrow as pa
from pyspark.sql import DataFrame

from tableworks.llm.batches import keyed, map_texts, utf8
from tableworks.llm.words import Pieces, tokenizer_path

#: Bytes of a chunk; pairs of tokens whose border is remembered in a Python worker.
CHUNK, PAIRS = 16_384, 400_000


class CountTransducer:
    """Symbols of a word → number of tokens of its byte-pair segmentation."""

    def __init__(self, merges: list, vocab: dict[str, int], end: str):
        self._rank: dict[tuple[str, str], int] = {}
        self._end = end
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in merges]
        size: dict[str, int] = {}  # symbols of a token that merging can make
        for token in vocab:
            if len(token) == 1 or len(token) == 1 + len(end) and token.endswith(end):
                size[token] = 1
        for n, (a, b) in enumerate(pairs):
            self._rank[a, b] = n
            if a in size and b in size and a + b not in size:
                size[a + b] = size[a] + size[b]
        # the automaton: nodes are prefixes of tokens
        self._next: list[dict[str, int]] = [{}]
        self._fail, ends = [0], [None]
        for token in size:
            node = 0
            for symbol in self._symbols(token):
                to = self._next[node].get(symbol)
                if to is None:
                    to = self._next[node][symbol] = len(self._next)
                    self._next.append({})
                    self._fail.append(0)
                    ends.append(None)
                node = to
            ends[node] = (token, size[token])
        self._ends: list[tuple] = [()] * len(ends)
        line = [0]
        for node in line:  # breadth first: shorter prefixes are ready
            for symbol, to in self._next[node].items():
                if node:
                    self._fail[to] = self._move(self._fail[node], symbol)
                own = ends[to]
                self._ends[to] = ((own,) if own else ()) + self._ends[self._fail[to]]
                line.append(to)
        self._borders: dict[tuple[str, str], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self._end)
        return [*body[:-1], body[-1] + token[len(body):]] if body else list(token)

    def _move(self, node: int, symbol: str) -> int:
        while (to := self._next[node].get(symbol)) is None:
            if not node:
                return 0
            node = self._fail[node]
        return to

    def _merged(self, symbols: list[str]) -> list[str]:
        """Merges in order of rank, leftmost first."""
        rank, parts = self._rank, symbols
        while len(parts) > 1:
            ranks = [rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            at = ranks.index(best)
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2:]]
        return parts

    def _border(self, left: str, right: str) -> bool:
        """True if the two tokens come out again when they are written together."""
        key = (left, right)
        if (known := self._borders.get(key)) is None:
            if len(self._borders) >= PAIRS:
                self._borders.clear()
            known = self._borders[key] = self._merged(
                [*self._symbols(left), *self._symbols(right)]) == [left, right]
        return known

    def count(self, symbols: list[str]) -> int:
        """Tokens of one word: the sum of what its transitions emit."""
        node, last, tokens = 0, [""], [0]
        borders, border, total = self._borders, self._border, 0
        for n, symbol in enumerate(symbols, 1):
            to = self._next[node].get(symbol)
            node = self._move(node, symbol) if to is None else to
            for token, size in self._ends[node]:
                at = n - size
                if at == 0 or (borders.get((last[at], token)) if (last[at], token) in borders else border(last[at], token)):
                    break
            else:
                raise ValueError(f"no token ends with {symbol!r}")
            emitted = tokens[at] + 1 - tokens[-1]
            total += emitted
            last.append(token)
            tokens.append(total)
        return total


class TextCounter:
    """Tokens of whole texts in UTF-8."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        end, transducer = model["end_of_word_suffix"], CountTransducer(
            model["merges"], model["vocab"], model["end_of_word_suffix"])
        self._pieces = Pieces(path, lambda w: transducer.count([*w[:-1], w[-1] + end]), lambda s: 1, 0)

    def _known(self, words: list[bytes]) -> int:
        return sum(self._pieces.look_up(words))

    def _map(self, chunk: bytes) -> tuple[bytes, int | None, bytes]:
        """A chunk as a map: what it adds to the word it is entered with, tokens of the words that begin
        and end inside (None: no white space, so the word goes on), the word it leaves unfinished."""
        words = chunk.split()
        if len(words) == 1 and len(words[0]) == len(chunk):
            return chunk, None, b""
        first = words.pop(0) if words and chunk[:1] not in _SPACE else b""
        last = words.pop() if words and chunk[-1:] not in _SPACE else b""
        return first, self._known(words), last

    def _then(self, left: tuple, right: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if left[1] is None:
            return left[0] + right[0], right[1], right[2]
        if right[1] is None:
            return left[0], left[1], left[2] + right[0]
        met = left[2] + right[0]
        return left[0], left[1] + right[1] + (self._known([met]) if met else 0), right[2]

    def count(self, text: bytes) -> int:
        """Tokens of a whole text."""
        if len(text) <= CHUNK:
            return self._known(text.split())
        maps = [self._map(text[at:at + CHUNK]) for at in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            pairs = [self._then(*maps[n:n + 2]) for n in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(pairs) * 2:]
        first, inner, last = maps[0]
        return (inner or 0) + self._known([w for w in (first, last) if w])


_SPACE = {b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"}


@functools.cache
def counter(path: str) -> TextCounter:
    """One transducer for each Python worker and vocabulary."""
    return TextCounter(path)


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    limit: int = 2048,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the library without added tokens. A null text counts as empty: no bytes, no
    tokens. Repeated rows are counted each, null identifiers stay null, an empty table gives an empty
    result, other columns are ignored. ``path`` names a ``word_bpe`` vocabulary on every machine.
    """
    path = path or tokenizer_path()

    def count(batch):
        texts, know = utf8(batch, "text"), counter(path)
        counts = [know.count(t) for t in texts]
        return {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(map(len, texts), pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
                "over_limit": pa.array([n > limit for n in counts], pa.bool_())}

    return map_texts(keyed(docs, id_col, text_col), count,
                     "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
