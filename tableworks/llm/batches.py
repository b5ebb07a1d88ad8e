"""Helpers that feed whole texts to Arrow functions in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are turned into Python objects at a time.
ROWS = 512

#: What empties the memos of this Python worker, and the stage whose tasks they were filled by.
_FORGET: list[Callable[[], None]] = []
_FILLED_BY: list[int | None] = [None]


def kept_for_a_stage(forget: Callable[[], None]) -> None:
    """Have ``forget`` called when this Python worker begins with the tasks of another stage."""
    _FORGET.append(forget)


def begin_task() -> None:
    """Drop the memos of another stage: a worker is used again by any later one, which has no use for them."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _FILLED_BY[0]:
        for forget in _FORGET:
            forget()
        pa.default_memory_pool().release_unused()
        _FILLED_BY[0] = stage


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema that Spark uses for a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches of a task cut into pieces of at most ``rows`` rows."""
    begin_task()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a column as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def map_texts(df: DataFrame, function: Callable, ddl: str) -> DataFrame:
    """``mapInArrow`` with a function from a record batch to a dict of columns.

    The function sees at most ``ROWS`` rows at a time, whole texts each.
    """
    schema = arrow_schema(df.sparkSession, ddl)

    def run(batches):
        for piece in slices(batches):
            columns = function(piece)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t)
                 for c, t in ((columns[f.name], f.type) for f in schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the identifier and the text, under the names ``doc_id`` and ``text``."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Texts of at most ``rows`` labelled documents: ``(doc_id, text, label)``.

    The identifiers with the smallest hashes are taken, so the choice repeats under any
    partitioning. Conflicting labels of one document count as the smaller one; a repeated
    document is taken once.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id is not null and label is not null")
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # at most `rows` rows of two numbers are sent to the executors
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return picked.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text"))
