"""Hard-negative mining: exact windows of inner products, found cell by cell in an inverted multi-index.

Every row is indexed. Rows lie in blocks of neighbouring cells (a large cell has several blocks), queries are dealt
to the blocks that their bounds allow, in batches, so a task holds one block and one batch. A search has two
rounds: each query first sees the block of its best cells, which gives a score to beat; then all others whose
bound reaches it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableworks.llm.batches import arrow_schema
from tableworks.llm.multi_index import Index, fit_codes
from tableworks.session import pin

#: Rows that the codebooks are fitted on at most, rows of a block, queries of a batch.
SAMPLE, BLOCK_ROWS, BATCH = 20_000, 8192, 512
#: Components beyond this size count as it, so that a sum of 64 products fits 64 bits.
LARGEST = 2 ** 28
_NO_ID = 2 ** 63 - 1


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part: each component x as floor(256 x), an array of integers.

    Rows with a null label, a null vector, or a null or non-finite component take no part.
    """
    plain = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                              F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("vector", lambda x: F.floor(F.greatest(F.least(x * 256, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return plain.filter(F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(~odd).select(
        "vec_id", "label", whole.alias("vector"))


def shifted_labels(vectors: DataFrame) -> DataFrame:
    """Labels of rows whose identifier is divisible by 7 become (label + 1) % 10."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros to ``width``."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes, values = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    if len(values) == width * len(lists) and (sizes == width).all():
        return values.reshape(len(lists), width).astype(np.float64)
    out = np.zeros((len(lists), width))
    owner = np.repeat(np.arange(len(lists)), sizes)
    out[owner, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _codes(vectors: DataFrame, width: int, count: int, sample: int) -> Index:
    """Codebooks fitted in one task on the ``sample`` rows of the smallest hashes."""
    chosen = vectors.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(sample).coalesce(1)
    half, ddl = width // 2, "left binary, right binary"
    schema = arrow_schema(vectors.sparkSession, ddl)

    def run(batches):
        got = [_matrix(b.column("vector"), width) for b in batches]
        rows = np.concatenate(got) if got else np.zeros((0, width))
        codes = [fit_codes(rows[:, :half], count).tobytes(), fit_codes(rows[:, half:], count).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in codes], schema=schema)

    found = chosen.select("vector").mapInArrow(run, ddl).collect()  # no task runs over no rows
    if not found:
        return Index(np.zeros((1, half)), np.zeros((1, width - half)))
    return Index(np.frombuffer(found[0][0]).reshape(-1, half), np.frombuffer(found[0][1]).reshape(-1, width - half))


_ROWS = "vec_id long, label long, vector array<int>, cell int, left_far double, right_far double"


def build(vectors: DataFrame, width: int, codes: int, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> tuple[Index, DataFrame]:
    """The index, and all rows as ``row, vec_id, label, vector, cell, block``."""
    spark = vectors.sparkSession
    index = _codes(vectors, width, codes, sample)
    known, schema = spark.sparkContext.broadcast(index), arrow_schema(spark, _ROWS)

    def run(batches):
        for batch in batches:
            cell, a, b = known.value.assign(_matrix(batch.column("vector"), width))
            columns = [*(batch.column(c) for c in ("vec_id", "label", "vector")), cell, a, b]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type)
                                              for c, f in zip(columns, schema)], schema=schema)

    rows = pin(vectors.select("vec_id", "label", "vector").mapInArrow(run, _ROWS)
               .withColumn("row", F.monotonically_increasing_id()))
    # at most one row for each pair of codes
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("left_far").alias("a"), F.max("right_far").alias("b")).collect()
    index.fill([tuple(r) for r in cells], block_rows)
    places = spark.createDataFrame([(r["cell"], int(index.block[r["cell"]]), int(index.parts[r["cell"]])) for r in cells],
                                   "cell int, first int, parts int")
    placed = rows.join(F.broadcast(places), "cell").withColumn(
        "block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    return index, placed.select("row", "vec_id", "label", "vector", "cell", "block")


def _windows(scores: list[int] | None, low: int, high: int) -> list[tuple[float, float]]:
    """Least and largest admissible score for each score of a positive; one window without limits for none."""
    if scores is None:
        return [(-np.inf, np.inf)]
    return [(-(-low * s // 100), high * s // 100) for s in scores]


def _needed(windows: list, bests: list) -> float:
    """The least score that could still enter the result of a window; infinite if every window is empty."""
    return min((max(lo, best if best is not None else -np.inf) for (lo, hi), best in zip(windows, bests) if lo <= hi), default=np.inf)


def _first_cells(index: Index, query: np.ndarray, windows: list, block_rows: int) -> tuple[int, list]:
    """The block of the best cell, and which of its cells the first round visits, with their bounds."""
    home, found, seen = -1, [], 0
    need, top = _needed(windows, [None] * len(windows)), max(hi for _, hi in windows)
    for cell, bound, lower in index.cells(query):
        if bound < need or seen >= block_rows:
            break
        if lower > top:
            continue
        seen += int(index.count[cell])
        home = int(index.block[cell]) if home < 0 else home
        if index.block[cell] == home:
            found.append((cell, bound))
    return home, found


def _routes(index: Index, query: np.ndarray, windows: list, bests: list, block_rows: int, again: bool) -> dict[int, list]:
    """Block → its cells and bounds in falling order, for the first round or for what it has left."""
    home, begun = _first_cells(index, query, windows, block_rows)
    if not again:
        return {home: begun} if begun else {}
    done, routes = {c for c, _ in begun}, {}
    need, top = _needed(windows, bests), max(hi for _, hi in windows)
    for cell, bound, lower in index.cells(query):
        if bound < need:
            break
        if lower > top:
            continue
        first = int(index.block[cell])
        for block in range(first, first + int(index.parts[cell])):
            if block != home or cell not in done:
                routes.setdefault(block, []).append((cell, bound))
    return routes


_QUERY = "a long, vec_id long, label long, vector array<int>, scores array<long>, bests array<long>"
_ROUTE = f"block int, {_QUERY}, cells array<int>, bounds array<double>"
_FOUND = "a long, w int, score long, found long"


class _Tile:
    """The rows of a block by cell and label."""

    def __init__(self, table: pa.Table, width: int) -> None:
        cell, label = (table.column(c).to_numpy() for c in ("cell", "label"))
        ids = table.column("vec_id").fill_null(_NO_ID).to_numpy()
        order = np.lexsort((ids, label, cell))
        self.ids, self.labels, self.rows = ids[order], label[order], _matrix(table.column("vector"), width)[order]
        cells, starts = np.unique(cell[order], return_index=True)
        self.ranges = {int(c): (int(s), int(e)) for c, s, e in zip(cells, starts, [*starts[1:], len(order)])}
        self.norm = float(np.sqrt((self.rows ** 2).sum(1).max())) if len(order) else 0.0

    def scores(self, start: int, end: int, query: np.ndarray) -> np.ndarray:
        # sums below 2^53 are exact in floating point, others need integers
        if self.norm * np.sqrt((query ** 2).sum()) < 2.0 ** 52:
            return self.rows[start:end] @ query
        return self.rows[start:end].astype(np.int64) @ query.astype(np.int64)

    def search(self, query: np.ndarray, own: int, label: int, cells: list, bounds: list, windows: list, bests: list,
               same: bool, k: int) -> list[tuple[int, int, int]]:
        """``(window, score, identifier)`` of the first ``k`` rows of each window in these cells."""
        bests, found = list(bests), [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        need = _needed(windows, bests)
        for cell, bound in zip(cells, bounds):
            if bound < need:
                break
            start, end = self.ranges.get(cell, (0, 0))
            low = start + int(np.searchsorted(self.labels[start:end], label, "left"))
            high = start + int(np.searchsorted(self.labels[start:end], label, "right"))
            for start, end in ([(low, high)] if same else [(start, low), (high, end)]):
                if start == end:
                    continue
                scores = self.scores(start, end, query)
                if scores.max() < need:
                    continue
                for w, (lo, hi) in enumerate(windows):
                    least = max(lo, -np.inf if bests[w] is None else bests[w])
                    fine = (scores >= least) & (scores <= hi)
                    if same:
                        fine &= self.ids[start:end] != own
                    if not fine.any():
                        continue
                    score = np.concatenate([found[w][0], scores[fine].astype(np.int64)])
                    ids = np.concatenate([found[w][1], self.ids[start:end][fine]])
                    order = np.lexsort((ids, -score))[:k]
                    found[w] = score[order], ids[order]
                    if len(order) == k:
                        bests[w] = max(int(score[order[-1]]), -2 ** 63 if bests[w] is None else bests[w])
                need = _needed(windows, bests)
        return [(w, int(s), int(i)) for w, (score, ids) in enumerate(found) for s, i in zip(score, ids)]


def _round(index: Index, rows: DataFrame, queries: DataFrame, batches: int, width: int, same: bool, k: int, limits: tuple[int, int],
           block_rows: int, again: bool) -> DataFrame:
    """One round of a search: ``a, w, score, found``, at most ``k`` rows for each query, window and block."""
    spark = rows.sparkSession
    known, schema, out = spark.sparkContext.broadcast(index), arrow_schema(spark, _ROUTE), arrow_schema(spark, _FOUND)
    asked_columns = queries.columns

    def deal(chunks):
        for chunk in chunks:
            matrix, routed = _matrix(chunk.column("vector"), width), []
            for n, (scores, bests) in enumerate(zip(chunk.column("scores").to_pylist(), chunk.column("bests").to_pylist())):
                windows = _windows(scores, *limits)
                if windows:
                    for block, way in _routes(known.value, matrix[n], windows, bests or [None] * len(windows), block_rows, again).items():
                        routed.append((n, block, [c for c, _ in way], [b for _, b in way]))
            for at in range(0, len(routed), 4096):
                some = routed[at:at + 4096]
                taken = chunk.take(pa.array([r[0] for r in some], pa.int64()))
                columns = [pa.array([r[1] for r in some]), *(taken.column(c) for c in asked_columns),
                           pa.array([r[2] for r in some], pa.list_(pa.int32())), pa.array([r[3] for r in some], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def search(block, asked):
        tile, answers = _Tile(block, width), []
        matrix = _matrix(asked.column("vector"), width)
        for n, r in enumerate(asked.select(["a", "vec_id", "label", "scores", "bests", "cells", "bounds"]).to_pylist()):
            windows = _windows(r["scores"], *limits)
            answers += [(r["a"], w, s, None if i == _NO_ID else i) for w, s, i in tile.search(
                matrix[n], r["vec_id"], r["label"], r["cells"], r["bounds"], windows, r["bests"] or [None] * len(windows), same, k)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*answers)) or [()] * 4, out)], schema=out)

    routes = pin(queries.mapInArrow(deal, _ROUTE).withColumn("batch", F.pmod(F.xxhash64("a"), F.lit(batches)).cast("int")))
    # a block is laid out once for each batch that asks for it
    asking = routes.select(F.col("block").alias("asked_block"), F.col("batch").alias("asked_batch")).distinct()
    laid = rows.join(asking, F.col("block") == F.col("asked_block")).select(
        F.col("asked_block").alias("block"), F.col("asked_batch").alias("batch"), "vec_id", "label", "vector", "cell")
    tiles = laid.groupBy("block", "batch").cogroup(routes.groupBy("block", "batch"))
    return tiles.applyInArrow(search, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` answers of each window with their ``rank``."""
    order = W.partitionBy("a", "w").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(index: Index, rows: DataFrame, queries: DataFrame, batches: int, width: int, same: bool, k: int,
            limits: tuple[int, int], block_rows: int) -> DataFrame:
    """The first ``k`` rows of each window of each query: ``a, w, score, found, rank``."""
    rest = (batches, width, same, k, limits, block_rows)
    none = queries.withColumn("bests", F.lit(None).cast("array<long>"))
    early = pin(_first(_round(index, rows, none, *rest, again=False), k))
    # the score of the last place of each window, null where it is not filled: at most one entry for each positive
    last = early.filter(F.col("rank") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last"))
    windows = F.when(F.col("scores").isNull(), F.array(F.lit(0))).when(
        F.size("scores") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("scores") - 1))
    begun = queries.join(last, "a", "left").withColumn(
        "bests", F.transform(windows, lambda w: F.element_at("last", w))).drop("last")
    late = _round(index, rows, begun, *rest, again=True)
    return _first(early.drop("rank").unionByName(late), k)


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    codes: int | None = None, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, batch: int = BATCH,
) -> DataFrame:
    """One row per hard negative: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, label, vector`` as :func:`quantised` gives them. Anchors are the rows whose identifier is
    divisible by ``every``. Scores are integer inner products, ties go to the smaller identifier (null last). The
    positives are the first rows of the anchor's label with another identifier; the negatives of a positive are the
    first rows of another label with ``low <= 100 * score / positive score <= high``; positives of negative score have
    none. A shorter vector counts as filled with zeros. Every repeated row is a candidate, an anchor that is repeated
    whole is asked once; rows without an identifier are candidates only. An empty table gives an empty result; other
    columns are ignored. The result is exact whatever ``codes`` (of each half, by default growing with the root of
    the rows up to 256), ``sample``, ``block_rows`` and ``batch``.
    """
    vectors = vectors.select("vec_id", "label", "vector")
    anchor = F.col("vec_id") % every == 0
    number, width, asked = vectors.agg(F.count("*"), F.max(F.size("vector")), F.count_if(anchor)).first()
    width = max(2, width or 0)
    codes = codes or min(256, max(4, round((number / 200) ** 0.5)))
    index, rows = build(vectors, width, codes, sample, block_rows)
    rows = pin(rows)
    batches = max(1, -(-asked // batch))
    queries = pin(rows.filter(anchor).groupBy("vec_id", "label", "vector").agg(F.min("row").alias("a")).select(
        "a", "vec_id", "label", "vector", F.lit(None).cast("array<long>").alias("scores")))
    near = pin(_search(index, rows, queries, batches, width, True, positives, (low, high), block_rows))
    # at most `positives` scores for each anchor
    listed = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("all"))
    windows = queries.drop("scores").join(listed, "a").select("a", "vec_id", "label", "vector", F.col("all.score").alias("scores"))
    hard = _search(index, rows, pin(windows), batches, width, False, negatives, (low, high), block_rows)
    first = near.select("a", (F.col("rank") - 1).alias("w"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(first, ["a", "w"]).join(queries.select("a", F.col("vec_id").alias("anchor_id")), "a").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
