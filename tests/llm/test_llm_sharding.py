"""Sharding against its law and against other ways to deal the same groups."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tableworks.llm import sharding
from tableworks.llm.sharding import differenced, plan_shards, shard_documents, write_shards

FOLDER = "/root/testdata/sf0.01"


def loads(sizes, shard, shards):
    held = [0] * shards
    for size, s in zip(sizes, shard):
        held[s] += size
    return held


def largest_first(sizes, shards):
    held = [0] * shards
    for size in sorted(sizes, reverse=True):
        held[held.index(min(held))] += size
    return held


def plain_differencing(sizes, shards):
    """Sorted lists of members instead of a heap and trees."""
    parts = [(i, [(s, [i])] + [(0, [])] * (shards - 1)) for i, s in enumerate(sizes)]
    number = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0][0] - p[1][-1][0]), p[0]))
        one, two = parts[0][1], parts[1][1]
        new = sorted(((a + b, x + y) for (a, x), (b, y) in zip(one, reversed(two))), key=lambda t: -t[0])
        parts = parts[2:] + [(number, [(s - new[-1][0], m) for s, m in new])]
        number += 1
    return [sorted(sizes[i] for i in m) for _, m in parts[0][1]]


def test_differencing():
    assert sorted(loads([8, 7, 6, 5, 4], differenced([8, 7, 6, 5, 4], 2), 2)) == [14, 16]  # the textbook example
    assert differenced([], 3) == [] and len(set(differenced([5, 5, 5], 3))) == 3
    rng = random.Random(1)
    for shards, count in itertools.product([2, 3, 5], [1, 4, 30]):
        sizes = [rng.randrange(1, 1000) for _ in range(count)]
        got = defaultdict(list)
        for size, s in zip(sizes, differenced(sizes, shards)):
            got[s].append(size)
        want = [m for m in plain_differencing(sizes, shards) if m]
        assert sorted(sorted(m) for m in got.values()) == sorted(want)
    sizes = [rng.randrange(1, 100_000) for _ in range(5000)]
    spread = lambda held: max(held) - min(held)
    assert spread(loads(sizes, differenced(sizes, 24), 24)) < spread(largest_first(sizes, 24))


def checked(rows, docs, shards=24):
    """The law on the rows of a result: ``docs`` are (doc_id, text)."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert {r.law for r in rows} <= {"bytes"} and {r.grown_shard for r in rows} <= {None}
    slots, held = defaultdict(list), [0] * shards
    for r in rows:
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    place = defaultdict(set)
    by_id = defaultdict(set)
    for i, t in docs:
        by_id[i].add(t or "")
    for r in rows:
        if len(by_id[r.doc_id]) == 1:
            place[next(iter(by_id[r.doc_id]))].add(r.shard)
    assert all(len(s) == 1 for s in place.values())
    return held


def test_documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    held = checked(shard_documents(df).collect(), docs)
    groups = Counter()
    for _, t in docs:
        groups[t or ""] += len((t or "").encode()) + 8
    plain = loads(list(groups.values()), differenced(sorted(groups.values(), reverse=True), 24), 24)
    assert max(held) <= max(max(groups.values()), sum(held) / 24 * 1.001) and sum(held) == sum(plain)


@pytest.mark.usefixtures("many_pieces")
def test_hot_group_and_cases(spark, monkeypatch):
    """A third of all bytes is one text; repeated rows, nulls, empties, parcels of many groups."""
    monkeypatch.setattr(sharding, "COPIES", 7)
    rng = random.Random(2)
    rows = [(i, "one text that everybody has " * 3) for i in range(1500)] + [(7, "again")] * 40 + [(None, None)] * 30
    rows += [(2000 + i, "x" * rng.randrange(300)) for i in range(900)] + [(3000, None), (3001, ""), (3001, ""), (None, "orphan")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = checked(shard_documents(df, shards=5, parcels=64, slot_parts=6).collect(), rows, 5)
    rest = sorted(held)[:-1]
    assert max(held) == sum(len(t.encode()) + 8 for _, t in rows[:1500])  # nothing joins the hot group
    assert rest[-1] - rest[0] <= 0.01 * sum(held)
    assert shard_documents(df.limit(0)).count() == 0
    one = shard_documents(df.limit(1)).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_items_are_bounded(spark):
    rows = spark.range(20_000).selectExpr("sha2(cast(id as string), 256) as digest", "id % 100 + 9 as size", "1 as copies")
    rows = rows.selectExpr("unhex(digest) as digest", "size", "copies")
    plan = plan_shards(rows, 4, 32)
    assert plan.parcels.count() <= 32 and plan.large.count() <= 32


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i % 40}", i % 3) for i in range(200)] + [(None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies int")
    write_shards(df, f"{tmp_path}/out", shards=4, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert back.groupBy("text").agg({"shard": "max"}).count() == back.select("text", "shard").distinct().count()
    with pytest.raises(ValueError):
        write_shards(df.withColumnRenamed("copies", "shard"), f"{tmp_path}/other")
