"""Best-fit packing of tokenized documents with certified numbers of bins.

Documents are cut into pieces of at most one sequence. Pieces are dealt to partitions, each is packed
best-fit decreasing, and a dual-feasible-function bound says how many bins its pieces need at least.
A partition that meets its bound is done. One with a gap gives the pieces of its emptiest bins away;
they are dealt anew to fewer partitions and packed again, until one partition is left.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableworks.llm.batches import keyed, map_texts, utf8
from tableworks.llm.words import encode, tokenizer_path
from tableworks.session import pin

#: Pieces that one task packs, and how many partitions exchange pieces in a round.
PARTITION_ROWS, FAN_IN = 50_000, 8

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that the lengths need at least, by two families of dual feasible functions.

    ``f`` (a threshold t up to half the capacity): lengths above capacity − t count as whole bins, those
    below t as nothing. ``u`` (k): a length counts floor((k+1)·l/c)/k bins, or l/c where that is exact.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    rows, total = np.cumsum(count), np.cumsum(count * size)
    half = capacity // 2
    t = np.arange(0, half + 1)
    big = rows[-1] - rows[capacity - t]
    middle = total[capacity - t] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    best = int(np.max(big * capacity + middle))
    best = -(-best // capacity)
    for k in range(1, 33):
        scaled = (k + 1) * size
        weight = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # times k·capacity
        best = max(best, -(-int((weight * count).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each length, and the room left in each bin; ties by position."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room: list[int] = []
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = mask >> need
        if fitting:
            left = need + (fitting & -fitting).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                mask ^= 1 << left
        else:
            left, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - left
        left -= need
        room[b] = left
        by_room[left].append(b)
        mask |= 1 << left
    return bins, offsets, room


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of the whole documents, each ended by ``end_id``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text")):
            ids = encode(path, text) + end
            for n, at in enumerate(range(0, len(ids), capacity * 4)):
                part = ids[at:at + capacity * 4]
                rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*rows)) or [()] * 5
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"),
                        (pa.array(c, t) for c, t in zip(columns, types))))

    return map_texts(docs, cut, _PIECES)


def _packer(capacity: int, level: int, last: bool):
    def pack(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        pieces = pieces.drop_columns("_part").sort_by("row")
        lengths = pieces["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(lengths, capacity)
        # a partition that misses its bound gives the pieces of its emptiest bins away
        given = np.zeros(len(room), bool)
        given[np.argsort(-np.array(room, np.int64), kind="stable")[: 0 if last else 4 * gap]] = True
        sequence = (np.int64(level) << np.int64(58)) + (np.int64(key[0].as_py()) << np.int64(32)) + bins
        return (pieces.append_column("sequence_id", pa.array(sequence))
                .append_column("offset", pa.array(offsets)).append_column("open", pa.array(given[bins])))

    return pack


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    capacity: int = 2048, end_id: int = 0, partition_rows: int = PARTITION_ROWS,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Pieces of a full sequence have one of their own. A null or empty text is one piece with the end
    token. Every row of a repeated document is packed. A null identifier stays null. An empty table
    gives an empty result; other columns are ignored.
    """
    path = path or tokenizer_path()
    # each pass below reads the same numbered pieces; they hold no text
    pieces = pin(tokenized_pieces(keyed(docs, id_col, text_col), path, capacity, end_id)
                 .withColumn("row", F.monotonically_increasing_id()))
    full = F.col("length") >= capacity
    done = pieces.filter(full).select(
        *pieces.columns, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.filter(~full)
    parts, level = max(1, -(-left.count() // partition_rows)), 0
    while True:
        last = parts == 1
        placed = left.withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(parts))).groupBy("_part").applyInArrow(
            _packer(capacity, level, last), f"{_PIECES}, row long, sequence_id long, offset long, open boolean")
        if last:
            break
        placed = pin(placed)
        done = done.unionByName(placed.filter("not open").drop("open"))
        left = placed.filter("open").drop("open", "sequence_id", "offset")
        parts, level = -(-parts // FAN_IN), level + 1
    return done.unionByName(placed.drop("open")).drop("row")
