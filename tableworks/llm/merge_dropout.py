"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merges are taken from an agenda, best score first and then leftmost. A candidate that comes up is skipped
when a hash keyed by the seed, the document, the place of the unit and its place there falls below the rate,
so every occurrence of a word draws its own segmentation, and each repeats. Spaces and line breaks cannot
be crossed by a piece, so a text is cut into units there. Units of like length share a matrix: a row holds the
symbols of a unit and the ranks of its neighbouring pairs, and each round takes the best pair of every row,
draws, and merges or skips, until no row has a pair left. At rate 0 the ids are those of the library.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tableworks.llm.batches import keyed, map_texts, strings
from tableworks.llm.words import tokenizer_path

#: Units that are drawn at a time, and the widths of the matrices; longer units have a heap of their own.
BLOCK, WIDTHS = 1 << 16, (2, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 21, 28, 40)
_NONE = np.iinfo(np.int32).max

_MARK = "▁"
_MIX, _LAST, _FULL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1


def _draw(x: int) -> int:
    """32 bits of a mixed 64-bit number."""
    x = x * _MIX & _FULL
    return ((x ^ x >> 32) * _LAST & _FULL) >> 32


def _draws(x: np.ndarray) -> np.ndarray:
    """The same for many."""
    x = x * np.uint64(_MIX)
    return (x ^ x >> np.uint64(32)) * np.uint64(_LAST) >> np.uint64(32)


class DropoutCoder:
    """Encoder and decoder of one vocabulary with one seed and rate."""

    def __init__(self, path: str, seed: int, rate: float):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        self.seed, self.limit = seed, int(rate * 2 ** 32)
        size = own.get_piece_size()
        self.bytes = {int(own.id_to_piece(i)[3:5], 16): i for i in range(size) if own.is_byte(i)}
        plain = [i for i in range(size) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        self.ids = {own.id_to_piece(i): i for i in plain}
        # smaller is better, as the agenda pops its smallest entry first
        self.rank = {own.id_to_piece(i): -own.get_score(i) for i in plain}
        self._codes = {p: xxhash.xxh64_intdigest(p, seed) for p in self.ids}
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        if any(_MARK in p.lstrip(_MARK) for p in self.ids):
            raise ValueError("a piece goes on after a space")
        # no piece joins a line break to anything
        breaks = "" if "\n" in joined else "\n"
        self._units = re.compile(f"[{breaks}]|{_MARK}+[^{_MARK}{breaks}]*|[^{_MARK}{breaks}]+" if breaks else f"{_MARK}*[^{_MARK}]+|{_MARK}+")
        self._table = {i: p.replace(_MARK, " ").encode() for p, i in self.ids.items()} | {
            i: bytes([b]) for b, i in self.bytes.items()}
        self._mark = np.array([self.bytes[b] for b in _MARK.encode()], np.uint32)
        self._tables()

    def _tables(self) -> None:
        """Symbols (pieces, and characters that only occur inside pieces) by code point, and what pairs of them make."""
        symbol = {p: n for n, p in enumerate(self.ids)}
        for p in self.ids:
            for c in p:
                symbol.setdefault(c, len(symbol))
        self._strange = len(symbol)  # any other character: joins nothing
        self._of_char = np.full(0x110000, self._strange, np.int32)
        for p, n in symbol.items():
            if len(p) == 1:
                self._of_char[ord(p)] = n
        self._id_of = np.array([self.ids.get(p, -1) for p in symbol] + [-1], np.int64)
        order = {x: n for n, x in enumerate(sorted(set(self.rank.values())))}
        self._code_of = np.array([self._codes.get(p, 0) for p in symbol], np.uint64)
        pairs = {}
        for p in self.ids:
            for cut in range(1, len(p)):
                left, right = symbol.get(p[:cut]), symbol.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * (self._strange + 1) + right] = (order[self.rank[p]], symbol[p])
        # two halves of a table of two slots for each hash; what fits neither is looked up in a sorted rest
        keys = np.array(sorted(pairs), np.int64)
        made = np.array([pairs[k] for k in keys.tolist()], np.int32).reshape(-1, 2)
        self._bits = max(4, int(len(keys)).bit_length() + 2)
        self._slots = np.full((2, 1 << self._bits), -1, np.int64)
        self._made = np.full((2, 1 << self._bits, 2), _NONE, np.int32)
        left = np.arange(len(keys))
        for half in range(2):
            _, first = np.unique(self._hashed(keys[left], half), return_index=True)
            at = self._hashed(keys[left[first]], half)
            self._slots[half, at], self._made[half, at] = keys[left[first]], made[left[first]]
            left = np.delete(left, first)
        self._rest, self._rest_made = keys[left], made[left]

    def _hashed(self, keys: np.ndarray, half: int) -> np.ndarray:
        mix = np.uint64((_MIX, _LAST)[half])
        return (keys.astype(np.uint64) * mix >> np.uint64(64 - self._bits)).astype(np.int64)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of what neighbours make, or no rank."""
        keys = left.astype(np.int64) * (self._strange + 1) + right
        at = self._hashed(keys, 0)
        found = self._made[0][at]
        rank, made = found[:, 0].copy(), found[:, 1].copy()
        missed = np.flatnonzero(self._slots[0][at] != keys)
        rank[missed] = _NONE
        # few keys share their first slot with another one, so most of these are no pairs at all
        again = keys[missed]
        at = self._hashed(again, 1)
        hit = self._slots[1][at] == again
        rank[missed[hit]], made[missed[hit]] = self._made[1][at[hit]].T
        if len(self._rest):
            missed, again = missed[~hit], again[~hit]
            at = np.minimum(np.searchsorted(self._rest, again), len(self._rest) - 1)
            hit = self._rest[at] == again
            rank[missed[hit]], made[missed[hit]] = self._rest_made[at[hit]].T
        return rank, made

    def _code(self, at: int, piece: str) -> int:
        code = self._codes.get(piece)
        return (xxhash.xxh64_intdigest(piece, self.seed) if code is None else code) + at * _LAST & _FULL

    def _skipped(self, key: int, at: int, piece: str) -> bool:
        return self.limit > 0 and _draw(key ^ self._code(at, piece)) < self.limit

    def segment(self, unit: str, key: int) -> list[str]:
        """Pieces of a unit; ``key`` stands for the document and the place of the unit."""
        pieces, rank = list(unit), self.rank
        n = len(pieces)
        agenda = []
        for i in range(n - 1):
            both = unit[i:i + 2]
            if both in rank:
                agenda.append((rank[both], i, i + 1, both))
        if not agenda:
            return pieces
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            # one of the two was merged meanwhile
            if after[i] != j or not pieces[i] or pieces[i] + pieces[j] != both:
                continue
            if self.limit and self._skipped(key, i, both):
                continue
            end = after[j]
            pieces[i], pieces[j], after[i] = both, "", end
            if end < n:
                before[end] = i
                new = both + pieces[end]
                if new in rank:
                    heapq.heappush(agenda, (rank[new], i, end, new))
            start = before[i]
            if start >= 0:
                new = pieces[start] + both
                if new in rank:
                    heapq.heappush(agenda, (rank[new], start, i, new))
        return [p for p in pieces if p]

    def _ids(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for piece in pieces:
            known = self.ids.get(piece)
            out += [known] if known is not None else [self.bytes[b] for b in piece.encode()]
        return array("I", out).tobytes()

    def _rounds(self, chars: np.ndarray, lengths: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        """Symbols of units of at most ``width`` characters after all rounds: a row each, -1 where a place was
        merged away or does not exist."""
        n = len(lengths)
        places = np.arange(width)
        symbols = np.full((n, width), -1, np.int32)
        symbols[places < lengths[:, None]] = self._of_char[chars]
        ranks, makes = np.full((n, width), _NONE, np.int32), np.zeros((n, width), np.int32)
        row, at = np.nonzero(places < lengths[:, None] - 1)
        ranks[row, at], makes[row, at] = self._merged(symbols[row, at], symbols[row, at + 1])
        # neighbours to the right and left; the place behind the last one is `width`
        after = np.broadcast_to((places + 1).astype(np.int8), (n, width)).copy()
        before = np.broadcast_to((places - 1).astype(np.int8), (n, width)).copy()
        live = np.arange(n)
        while True:
            block = ranks[live]
            at = block.argmin(1)
            open_ = block[np.arange(len(live)), at] != _NONE
            live, at = live[open_], at[open_]
            if not len(live):
                return symbols
            whole = makes[live, at]
            if self.limit:
                draws = _draws(keys[live] ^ (self._code_of[whole] + at.astype(np.uint64) * np.uint64(_LAST)))
                skip = draws < self.limit
                ranks[live[skip], at[skip]] = _NONE
                row, at, whole = live[~skip], at[~skip], whole[~skip]
            else:
                row = live
            gone = after[row, at].astype(np.int64)
            behind = after[row, gone].astype(np.int64)
            symbols[row, at], symbols[row, gone] = whole, -1
            ranks[row, gone], ranks[row, at] = _NONE, _NONE
            after[row, at] = behind
            inner = np.flatnonzero(behind < lengths[row])
            r, i, j = row[inner], at[inner], behind[inner]
            before[r, j] = i
            ranks[r, i], makes[r, i] = self._merged(symbols[r, i], symbols[r, j])
            front = before[row, at].astype(np.int64)
            inner = np.flatnonzero(front >= 0)
            r, i, j = row[inner], front[inner], at[inner]
            ranks[r, i], makes[r, i] = self._merged(symbols[r, i], symbols[r, j])

    def _tokens(self, symbols: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of final symbols, and how many each has; a character without a piece becomes its bytes."""
        ids = self._id_of[symbols]
        sizes = np.ones(len(ids), np.int64)
        strange = np.flatnonzero(ids < 0)
        if not len(strange):
            return ids.astype(np.uint32), sizes
        codes, which = np.unique(chars[strange], return_inverse=True)
        spelled = [[self.bytes[b] for b in chr(c).encode()] for c in codes.tolist()]
        sizes[strange] = np.array([len(x) for x in spelled])[which]
        out = np.repeat(ids, sizes)
        starts = np.cumsum(sizes) - sizes
        for number, own in enumerate(spelled):
            mine = starts[strange[which == number]]
            for k, b in enumerate(own):
                out[mine + k] = b
        return out.astype(np.uint32), sizes

    def _drawn(self, units: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and how many each has; None is a mark that the text itself holds."""
        lengths = np.fromiter((0 if u is None else len(u) for u in units), np.int64, len(units))
        chars = np.frombuffer("".join([u for u in units if u]).encode("utf-32-le", "surrogatepass"), "<u4")
        starts, counts, parts = np.cumsum(lengths) - lengths, np.zeros(len(units), np.int64), []
        group = np.searchsorted(WIDTHS, lengths)
        for number, width in enumerate(WIDTHS):
            mine = np.flatnonzero((group == number) & (lengths > 0))
            if not len(mine):
                continue
            sizes = lengths[mine]
            own = chars[np.repeat(starts[mine] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            symbols = self._rounds(own, sizes, keys[mine], width)
            row, at = np.nonzero(symbols >= 0)
            ids, each = self._tokens(symbols[row, at], chars[starts[mine][row] + at])
            counts[mine] = np.bincount(row, each, len(mine)).astype(np.int64)
            parts.append((mine, ids))
        for n in np.flatnonzero((group == len(WIDTHS)) | (lengths == 0)).tolist():
            ids = self._mark if units[n] is None else np.frombuffer(self._ids(self.segment(units[n], int(keys[n]))), "<u4")
            counts[n] = len(ids)
            parts.append((np.array([n]), ids))
        ends, out = np.cumsum(counts), np.zeros(counts.sum(), np.uint32)
        for mine, ids in parts:
            sizes = counts[mine]
            out[np.repeat(ends[mine] - sizes - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
        return out, counts

    def _cut(self, text: str) -> list[str | None]:
        """Units of a text; a mark in the text itself is None, or it would decode to a space."""
        units: list[str | None] = []
        for number, part in enumerate((" " + text).split(_MARK)):
            units += [None] * (number > 0) + self._units.findall(part.replace(" ", _MARK))
        return units

    def _keys(self, key: int, count: int) -> np.ndarray:
        """A key of each unit of a document."""
        start = np.uint64(xxhash.xxh64_intdigest(b"%d" % key, self.seed))
        x = (np.arange(count, dtype=np.uint64) * np.uint64(_LAST) + start) * np.uint64(_MIX)
        return (x ^ x >> np.uint64(29)) * np.uint64(_LAST)

    def encode_all(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """``encode`` of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, units, numbers = [], [], []

        def settle():
            ids, counts = self._drawn(units, np.concatenate(numbers))
            ends, at = [0, *np.cumsum(counts).tolist()], 0
            for n, count in waiting:
                out[n].append(ids[ends[at]:ends[at + count]].tobytes())
                at += count
            for kept in (waiting, units, numbers):
                kept.clear()

        for n, (text, key) in enumerate(zip(texts, keys)):
            cut = self._cut(text) if text else []
            own = self._keys(key, len(cut))
            for start in range(0, len(cut), BLOCK):
                part = cut[start:start + BLOCK]
                waiting.append((n, len(part)))
                units += part
                numbers.append(own[start:start + BLOCK])
                if len(units) >= BLOCK:
                    settle()
        if units:
            settle()
        return [b"".join(parts) for parts in out]

    def encode(self, text: str, key: int) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes; ``key`` stands for the document."""
        return self.encode_all([text], [key])[0]

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids."""
        data = b"".join(map(self._table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data[1:].decode()


@functools.cache
def coder(path: str, seed: int, rate: float) -> DropoutCoder:
    """One coder for each Python worker."""
    return DropoutCoder(path, seed, rate)


def _path(path: str | None) -> str:
    return path or tokenizer_path("piece_bpe_32k.model")


def encoded(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    seed: int = 17, rate: float = 0.1,
) -> DataFrame:
    """One row per document: ``doc_id, ids`` (array of int). A null or empty text has no ids; repeated rows
    of one identifier are segmented alike, a null identifier counts as 0 for the hash and stays null; an
    empty table gives an empty result; other columns are ignored."""
    path = _path(path)

    def run(batch):
        own, keys = coder(path, seed, rate), batch.column("doc_id").to_pylist()
        coded = own.encode_all(strings(batch, "text"), [k or 0 for k in keys])
        ids = [np.frombuffer(x, "<i4") for x in coded]
        return {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))}

    return map_texts(keyed(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None, seed: int = 17, rate: float = 0.1) -> DataFrame:
    """``doc_id, text`` of what ``encoded`` gives; the text that was encoded, null texts as empty ones."""
    path = _path(path)

    def run(batch):
        own = coder(path, seed, rate)
        texts = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())}

    return map_texts(ids.select("doc_id", "ids"), run, "doc_id long, text string")


def dropout_digest(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    seed: int = 17, rate: float = 0.1,
) -> DataFrame:
    """One row per document: ``doc_id, n_chars, n_tokens, ids_crc32, lossless``: the ids of ``encoded`` as a
    count and a checksum, and whether decoding them gives the text back. Cases as there."""
    path = _path(path)

    def run(batch):
        own, rows, texts = coder(path, seed, rate), [], strings(batch, "text")
        for text, ids in zip(texts, own.encode_all(texts, [k or 0 for k in batch.column("doc_id").to_pylist()])):
            rows.append((len(text), len(ids) // 4, zlib.crc32(ids), own.decode(ids) == text))
        names = ["n_chars", "n_tokens", "ids_crc32", "lossless"]
        columns = list(zip(*rows)) or [()] * len(names)
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, columns))

    return map_texts(keyed(docs, id_col, text_col), run,
                     "doc_id long, n_chars long, n_tokens long, ids_crc32 long, lossless boolean")
