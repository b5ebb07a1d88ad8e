"""Sharding by bytes: Karmarkar-Karp differencing of groups that must stay together.

Rows of equal texts are a group. A group that is large against all bytes is an item of its own; the others
are gathered by a hash of their digest into a fixed number of parcels. So there are a bounded number of
items whatever the input, of many different sizes, and their bytes come from one aggregate over all rows.
The differencing starts with one partial partition per item (the item in one shard, nothing in the others)
and combines the two of the largest spread, the fullest shard of one with the emptiest of the other, until
one is left. Groups of one parcel, and rows of one group, share its shard.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableworks.session import pin

SHARDS = 24
#: Parcels of small groups; a group of more than this part of all bytes is an item of its own. Both kinds
#: together are at most twice as many items.
PARCELS = 256 * SHARDS
#: Parts in which the rows of a shard are numbered, and copies of a row that are made at a time.
SLOT_PARTS, COPIES = 1024, 4096
#: What a row takes besides its text.
ROW_BYTES = 8


def differenced(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, by differencing; ties are settled by the place in the list.

    A partial partition has one (sum, members) for each shard, fullest first, less what the emptiest holds.
    """
    heap = []
    for n, size in enumerate(sizes):
        heap.append((-size, n, [(size, n)] + [(0, None)] * (shards - 1)))
    heapq.heapify(heap)
    joined: list[tuple] = []  # members are items, or (from len(sizes) on) pairs of members
    number = len(sizes)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        parts = []
        for (a, left), (b, right) in zip(one, reversed(two)):
            if left is None or right is None:
                parts.append((a + b, right if left is None else left))
            else:
                parts.append((a + b, len(sizes) + len(joined)))
                joined.append((left, right))
        parts.sort(key=lambda p: -p[0])
        least = parts[-1][0]
        heapq.heappush(heap, (least - parts[0][0], number, [(s - least, m) for s, m in parts]))
        number += 1
    shard = [0] * len(sizes)
    for place, (_, members) in enumerate(heap[0][2] if heap else []):
        stack = [] if members is None else [members]
        while stack:
            at = stack.pop()
            if at < len(sizes):
                shard[at] = place
            else:
                stack += joined[at - len(sizes)]
    return shard


@dataclass
class Plan:
    """Shards of large groups by digest and of parcels by number: at most ``2 * parcels`` rows in all."""

    large: DataFrame
    parcels: DataFrame
    count: int


def _marks(text: Column) -> dict[str, Column]:
    """Digest, bytes with those of the row, and CRC-32 of a text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return {"digest": F.unhex(F.sha2(text, 256)), "size": F.octet_length(text).cast("long") + ROW_BYTES,
            "text_crc32": F.crc32(text.cast("binary"))}


def _parcel(count: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(count)).cast("int")


def plan_shards(rows: DataFrame, shards: int = SHARDS, parcels: int = PARCELS) -> Plan:
    """The plan for rows of ``digest, size, copies``; equal digests are one group."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    groups = rows.groupBy("digest").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"))
    large = F.col("bytes") > total // parcels
    items = groups.select(F.when(large, F.col("digest")).alias("group"), F.when(~large, _parcel(parcels)).alias("parcel"), "bytes")
    # at most `parcels` large groups and `parcels` parcels
    found = sorted(((r["bytes"], -1 if r["parcel"] is None else r["parcel"], bytes(r["group"] or b"")) for r in
                    items.groupBy("group", "parcel").agg(F.sum("bytes").alias("bytes")).collect()), reverse=True)
    shard = differenced([size for size, _, _ in found], shards)
    placed = list(zip(found, shard))
    return Plan(
        spark.createDataFrame([(g, s) for (_, p, g), s in placed if p < 0], "digest binary, large_shard int"),
        spark.createDataFrame([(p, s) for (_, p, _), s in placed if p >= 0], "parcel int, parcel_shard int"), parcels)


def placed_rows(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows with a ``digest`` and their ``shard``; the two lists of the plan are bounded by its parcels."""
    found = rows.withColumn("parcel", _parcel(plan.count)).join(F.broadcast(plan.large), "digest", "left").join(
        F.broadcast(plan.parcels), "parcel", "left")
    return found.withColumn("shard", F.coalesce("large_shard", "parcel_shard")).drop("large_shard", "parcel_shard", "parcel")


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Equal rows (identifier and text) once, with their number; the text itself stays behind."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = rows.select("doc_id", *(c.alias(n) for n, c in _marks(F.col("text")).items()))
    return marks.groupBy("doc_id", "digest", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
    parcels: int = PARCELS, slot_parts: int = SLOT_PARTS,
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: shards are as equal in bytes as groups of equal texts allow; a group larger than a
    shard's share has a shard that gets nothing else as long as the others are emptier. A null text counts as
    empty. Every row of a repeated document has a place of its own; null identifiers keep theirs and are null.
    Slots run from 0 in each shard. Fewer groups than shards leave shards empty; an empty table gives an empty
    result; other columns are ignored.
    """
    # texts are read once; what follows reads these narrow rows
    rows = pin(_counted(docs, id_col, text_col))
    placed = placed_rows(rows, plan_shards(rows, shards, parcels)).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(slot_parts)).cast("int"))
    inside = W.partitionBy("shard", "part").orderBy("doc_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    # one row for each part of each shard
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy("shard", "part").agg(F.sum("copies").alias("copies")).select(
        "shard", "part", F.coalesce(F.sum("copies").over(before), F.lit(0)).alias("first"))
    numbered = placed.withColumn("earlier", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(
        F.broadcast(parts), ["shard", "part"])
    some = numbered.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    start = F.col("lot") * COPIES
    each = some.withColumn("copy", F.explode(F.sequence(start, F.least(start + COPIES, F.col("copies")) - 1)))
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("earlier") + F.col("copy")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(
    docs: DataFrame, path: str, text_col: str = "text", shards: int = SHARDS, parcels: int = PARCELS,
    files: int = 1,
) -> None:
    """All rows and columns of ``docs`` as Parquet in one folder ``shard=n`` per shard that has rows.

    ``files`` tasks write each shard, dealt by row. Texts are placed as :func:`shard_documents` does. A column
    called ``shard`` or ``digest`` cannot be written next to them and raises.
    """
    clash = {"shard", "digest"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be written over")
    names = docs.columns
    marks = _marks(F.col(f"`{text_col}`"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *(c.alias(n) for n, c in marks.items()))
    counted = pin(rows.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("copies")))
    placed = placed_rows(rows.select("row", "digest"), plan_shards(counted, shards, parcels))
    dealt = placed.repartition(shards * files, "shard", F.pmod(F.xxhash64("row"), F.lit(files)))
    dealt.select("row.*", "shard").write.partitionBy("shard").parquet(path)
