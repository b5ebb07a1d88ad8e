"""Near duplicates: Order MinHash buckets, a parity filter, banded alignment, connected classes.

Equal word sequences are one node from the start. In every bucket of the sketch whose nodes are not yet in
one class, a leader drawn by hash is compared with the nodes of other classes; classes that are linked
become one, and this is repeated a few times with other leaders. That joins large groups of copies in work
linear in their size. What is still apart is compared across classes inside its bucket, behind two exact
bounds that the join evaluates itself: lengths, and the parities of the k-mers (differing bits never
outnumber differing k-mers). Pairs that pass are aligned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableworks.llm import order_minhash as omh
from tableworks.llm.batches import map_texts, strings
from tableworks.operators.fuzzy import components
from tableworks.session import pin, scratch_path

#: 64-bit words of the parity signature; rounds of leaders before classes are compared with each other.
_SIGNATURE, ROUNDS = 16, 2
_INFO = ["n", *(f"s{i}" for i in range(_SIGNATURE))]
#: Slots of the rows whose words a round needs; they are broadcast, so their number is fixed.
SLOTS = 1 << 21


def _signature(grams: np.ndarray) -> np.ndarray:
    """For each of 1024 buckets of k-mers, whether their number is odd."""
    odd = np.bincount((grams >> np.uint64(7)).astype(np.int64) % (64 * _SIGNATURE), minlength=64 * _SIGNATURE) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text_md5, same, n, s0…, keys, codes``: ``same`` marks the word sequence, null without words."""

    def make(batch):
        rows = []
        for text in strings(batch, "text"):
            codes = omh.word_codes(text)
            grams = omh.kmers(codes)
            same = hashlib.md5(" ".join(omh._WORD.findall(text.lower())).encode()).digest() if len(codes) else None
            rows.append((same, len(grams), *_signature(grams).tolist(), omh.sketch(grams).tolist(), codes.tobytes()))
        names = ["same", *_INFO, "keys", "codes"]
        columns = list(zip(*rows)) or [()] * len(names)
        return {c: batch.column(c) for c in ("row", "doc_id", "text_md5")} | dict(zip(names, columns))

    return map_texts(docs, make, "row long, doc_id long, text_md5 string, same binary, n int, "
                     + ", ".join(f"s{i} long" for i in range(_SIGNATURE)) + ", keys array<long>, codes binary")


def _info(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in _INFO))


def _possible(a: str, b: str):
    """The bounds that any pair of this similarity meets, from lengths and parities."""
    total = F.col(f"{a}_n") + F.col(f"{b}_n")
    differ = sum((F.bit_count(F.col(f"{a}_s{i}").bitwiseXOR(F.col(f"{b}_s{i}"))) for i in range(_SIGNATURE)), F.lit(0))
    band = F.floor(total * ((1 - omh.SIMILAR) / (1 + omh.SIMILAR)) + 1e-9)
    return (F.abs(F.col(f"{a}_n") - F.col(f"{b}_n")) <= band) & (differ <= band)


def _slot(row: str):
    return F.pmod(F.xxhash64(row), F.lit(SLOTS)).cast("int")


def _needed(codes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``codes`` in a slot of ``a`` or ``b`` of any pair: all that the pairs name, and few others.

    Slots are broadcast, at most ``SLOTS`` of them, so the words of other texts are dropped where they are read.
    """
    slots = pairs.select(F.explode(F.array("a", "b")).alias("row")).select(_slot("row").alias("_slot")).distinct()
    return codes.join(F.broadcast(slots), _slot("row") == F.col("_slot"), "left_semi")


def _linked(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The classes ``(src, dst)`` of the pairs ``(a, b, a_class, b_class)`` whose alignment reaches the
    similarity, each once."""

    def check(batch):
        src, dst = [], []
        for a, b, left, right in zip(*(batch.column(c).to_pylist() for c in ("a_class", "b_class", "left", "right"))):
            one, two = (omh.kmers(np.frombuffer(x, np.uint32)) for x in (left, right))
            if omh.aligned(one, two) >= omh.SIMILAR:
                src.append(a)
                dst.append(b)
        return {"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())}

    pairs = pin(pairs)
    codes = _needed(codes, pairs)
    with_codes = (
        pairs.join(codes.select(F.col("row").alias("a"), F.col("codes").alias("left")), "a")
        .join(codes.select(F.col("row").alias("b"), F.col("codes").alias("right")), "b")
    )
    found = map_texts(with_codes.select("a_class", "b_class", "left", "right"), check, "src long, dst long")
    return pin(found.distinct())


def _hooked(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """``placed`` with each class under the smallest class it is linked to."""
    under = edges.groupBy(F.greatest("src", "dst").alias("class")).agg(F.min(F.least("src", "dst")).alias("_under"))
    return pin(placed.join(under, "class", "left").select("key", "node", F.coalesce("_under", "class").alias("class")))


def _closed(edges: DataFrame) -> DataFrame:
    """``(node, class)`` of the nodes that the edges connect."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return components(edges, ends).select(F.col("id").alias("node"), F.col("component").alias("class"))


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one class."""
    keys = placed.groupBy("key").agg(F.min("class").alias("_lo"), F.max("class").alias("_hi")).filter("_lo <> _hi")
    return placed.join(keys.select("key"), "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept, text_md5``.

    Texts are linked when at least 0.8 of their occurrence-labelled five-word k-mers align in order;
    classes are the connected texts. ``class_id`` is the smallest identifier of the class, ``class_size``
    its number of rows, and one row (of the smallest identifier) is kept. Words are runs of letters and
    digits in lower case; a text of fewer than five words is one k-mer. A null, empty or wordless text is
    a class of its own. Repeated rows are copies; null identifiers come last; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "near")
    _sketches(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_md5"),
        F.col(text_col).cast("string").alias("text"))).write.parquet(path)
    rows = spark.read.parquet(path)
    worded = rows.filter("same is not null")
    # the first row of each word sequence stands for all of them
    first = pin(worded.groupBy("same").agg(F.min("row").alias("node")))
    nodes = worded.select("row", *_INFO, "keys").join(first.select("node"), F.col("row") == F.col("node"))
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    counts = buckets.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
    placed = pin(buckets.join(counts.select("key"), "key").withColumn("class", F.col("node")))
    info, codes = rows.select(F.col("row").alias("node"), *_INFO), rows.select("row", "codes")
    links = None
    for number in range(ROUNDS):
        mixed = _mixed(placed)
        leaders = mixed.groupBy("key").agg(F.min(F.struct(
            F.xxhash64("node", F.lit(number)).alias("_hash"), F.col("node").alias("a"), F.col("class").alias("a_class"))).alias("_l"))
        pairs = mixed.join(leaders.select("key", "_l.a", "_l.a_class"), "key").filter("class <> a_class").select(
            "a", F.col("node").alias("b"), "a_class", F.col("class").alias("b_class")).distinct()
        near = pairs.join(_info(info, "a"), "a").join(_info(info, "b"), "b").filter(_possible("a", "b")).select(
            "a", "b", "a_class", "b_class")
        edges = _linked(near, codes)
        links = edges if links is None else links.union(edges)
        placed = _hooked(placed, edges)
    # classes are named by nodes, so the links of all rounds close over nodes
    links = pin(links.distinct())
    placed = placed.drop("class").join(_closed(links), "node", "left").withColumn("class", F.coalesce("class", "node"))
    keys = nodes.select("node", "keys")
    left = pin(_mixed(placed).join(info, "node").join(keys, "node"))
    one, two = (left.select(F.col("key").alias(f"{x}_key"), F.col("class").alias(f"{x}_class"), F.col("keys").alias(f"{x}_keys"),
                            *(F.col(c).alias(f"{x}_{c}") for c in _INFO), F.col("node").alias(x)) for x in ("a", "b"))
    # a pair that shares several buckets comes out of the first of them only
    first_shared = F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("a_key")
    across = one.join(two, (F.col("a_key") == F.col("b_key")) & (F.col("a") < F.col("b")) & (
        F.col("a_class") != F.col("b_class")) & _possible("a", "b") & first_shared).select("a", "b", "a_class", "b_class")
    linked = first.join(_closed(links.union(_linked(across, codes))), "node", "left").select(
        "same", F.coalesce("class", "node").alias("class"))
    last = F.lit(2 ** 63 - 1)
    sequences = worded.groupBy("same").agg(
        F.count("*").alias("size"), F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "row", "doc_id")).alias("best"))
    classes = sequences.join(linked, "same")
    whole = classes.groupBy("class").agg(F.sum("size").alias("size"), F.min("best").alias("best"))
    found = worded.select("row", "doc_id", "text_md5", "same").join(
        classes.select("same", "class").join(whole, "class"), "same").select(
        "doc_id", F.col("best.doc_id").alias("class_id"), F.col("size").alias("class_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), "text_md5")
    alone = rows.filter("same is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "text_md5")
    return found.unionByName(alone)
