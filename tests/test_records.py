"""CSV records across lines and blocks against a reader of single characters."""

import random

import pytest

from tableworks.sources import readers
from tableworks.sources.records import cells_of, csv_records


def plain_records(text):
    """Records of a whole text, one character at a time: ``[(cells), …]``; None if it ends inside quotes."""
    records, cells, cell, state, at, begun = [], [], "", "start", 0, 0
    while at < len(text):
        c = text[at]
        if state == "inside":
            if c == '"':
                state = "closed"
            else:
                cell += c
        elif c == "\n":
            if text[begun:at].strip(" "):  # a blank line is no record
                records.append([*cells, cell])
            cells, cell, state, begun = [], "", "start", at + 1
        elif c == ",":
            cells.append(cell)
            cell, state = "", "start"
        elif c == '"' and state in ("start", "closed"):
            cell += '"' if state == "closed" else ""
            state = "inside"
        else:
            cell += c
            state = "plain"
        at += 1
    if state == "inside":
        return None
    if text[begun:].strip(" "):
        records.append([*cells, cell])
    return records


def some_text(rng, lines):
    parts = ['"', '""', ",", "\n", "a", "b c", "é", '5" pipe', '"x,y"', '"two\nlines"', '"one ""q"" more"', " ", '"",', ',"\n\n",']
    while True:
        text = "h1,h2,h3\n" + "".join(rng.choice(parts) for _ in range(lines))
        if plain_records(text) is not None and '\n"' != text[-2:]:
            return text


@pytest.fixture
def tiny_blocks(spark):
    """Files cut into blocks of a few bytes, read by several tasks."""
    keys = {"spark.sql.files.maxPartitionBytes": "31", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_random_files(spark, tmp_path, tiny_blocks):
    rng, want = random.Random(1), {}
    for n in range(40):
        text = some_text(rng, rng.choice([3, 20, 120]))
        path = tmp_path / f"t{n}" / "data.csv"
        path.parent.mkdir()
        path.write_text(text, newline="")
        want[f"t{n}"] = plain_records(text)
    got = {}
    for r in csv_records(spark, str(tmp_path)).orderBy("path", "pos").collect():
        got.setdefault(r.path.split("/")[-2], []).append(cells_of(r.record))
    assert got == want


def test_plan_has_no_sort_aggregate(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.csv").write_text('x,y\n1,"2\n3"\n')
    rows, _ = readers.read_corpus(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Cartesian" not in plan


def test_unclosed_quote_and_surplus(spark, tmp_path, tiny_blocks):
    """A quote that is never closed leaves the lines behind it as records; cells beyond the header are kept."""
    for name, text in {"a": 'k,v\n1,"two\nlines"\n2,"open\n3,x\n4,y\n', "b": "﻿k,v\n1,2,3,\n4\r\n  \n5,6\n", "c": "k,v\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.csv").write_bytes(text.encode())
    rows, headers = readers.read_corpus(spark, str(tmp_path))
    assert {r.table_id: r.columns for r in headers.collect()} == {x: ["k", "v"] for x in "abc"}
    got = {}
    for r in rows.orderBy("table_id", "pos").collect():
        got.setdefault(r.table_id, []).append((r.cells, r.surplus))
    assert got["a"] == [(["1", "two\nlines"], None), (["2", "open"], None), (["3", "x"], None), (["4", "y"], None)]
    assert got["b"] == [(["1", "2"], ["3", ""]), (["4", None], None), (["5", "6"], None)]


def test_long_cells(spark, tmp_path):
    """A cell of many quotes and line breaks, longer than any block."""
    cell = 'say "yes"\n' * 20_000
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.csv").write_text('k,v\n1,"' + cell.replace('"', '""') + '"\n2,z\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.read_corpus(spark, str(tmp_path))[0].orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.cells for r in rows] == [["1", cell], ["2", "z"]]


def test_records_of_a_corpus_are_worked_out_once(spark, tmp_path):
    (tmp_path / "a_data").mkdir()
    (tmp_path / "a_data" / "table.csv").write_text('k,v\n1,"x\ny"\n2,z\n3,w,more\n')
    rows, _ = readers.read_corpus(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().toString()
    assert "text" not in [word.lower() for line in plan.splitlines() if "FileScan" in line for word in line.split()]
    # facts of files are small, so the records are not dealt by file to meet them
    assert "SortMergeJoin" not in plan
    assert sorted((r.cells, r.surplus) for r in rows.collect()) == [
        (["1", "x\ny"], None), (["2", "z"], None), (["3", "w"], ["more"])]
