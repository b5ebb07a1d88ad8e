"""Exact duplicates by merging runs of digests in a tree.

Documents are dealt to runs by a hash of their identifier, so copies of one text are spread over
all runs. A run holds each digest once. Rounds then merge ``fan_in`` runs into one, as a k-nomial
tree does, until one run is left; that run is partitioned by digest like every other. The way back
hands the surviving identifier down the same tree, so that no join ever sees more than ``fan_in``
rows of a digest on one side, and the documents meet only the copies in their own run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableworks.session import pin

_DIGEST = ["sha", "bytes", "check"]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, sha, bytes, check)``: three independent marks of the unchanged text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
    ).select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("sha"),
        F.octet_length("text").cast("long").alias("bytes"), F.xxhash64("text").alias("check"),
    )


def _merge(runs: DataFrame, fan_in: int) -> DataFrame:
    """``fan_in`` runs become one: equal digests meet, the best row and the number of rows are kept."""
    return (
        runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        .groupBy("run", *_DIGEST)
        .agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, fan_in: int = 16,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when SHA-256, length in bytes and a 64-bit hash all agree, so a colliding digest
    alone never joins two texts. Of equal texts the row with the largest identifier stays; a null
    identifier loses against any other. When several rows share text and identifier, one of them is
    kept. A null text counts as empty. An empty table gives an empty result; other columns are
    ignored. ``fan_in ** rounds`` runs are made at first.
    """
    # written once, so that the way down reads the same rows as the way up
    rows = pin(
        digests(docs, id_col, text_col)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("run", F.pmod(F.xxhash64("row"), F.lit(fan_in ** rounds)).cast("int"))
    )
    levels = [rows.groupBy("run", *_DIGEST).agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("size"))]
    for _ in range(rounds):
        levels.append(_merge(levels[-1], fan_in))
    down = levels.pop()
    while levels:
        level = levels.pop().drop("best", "size")
        above = down.withColumnRenamed("run", "_above")
        down = level.withColumn("_above", F.floor(F.col("run") / fan_in).cast("int")).join(
            above, ["_above", *_DIGEST]).drop("_above")
    return rows.join(down, ["run", *_DIGEST]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
