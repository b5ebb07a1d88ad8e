"""Repair of conversations against a plain version: one state at a time, whole strings of edits compared."""

import hashlib
import random
import re
import zlib

import pytest

from tableworks.llm.conversation_repair import damaged, repair_report, repaired_turns, turns
from tableworks.llm.edit_blocks import BLOCK, blocks, summary, tables, trace

KEEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ONWARD = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else
                   "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def repair(rows):
    """Cost, edits and lines of the cheapest repair of ``(turn, role, text)``, ties ASCII-least."""

    def closed(ways):
        for _ in range(3):
            ways = [min([w for w in (ways[q], (ways[ONWARD[q]][0] + 2, "I" + ways[ONWARD[q]][1],
                                               [ROLE[ONWARD[q]] + ":"] + ways[ONWARD[q]][2])) if w]) for q in range(4)]
        return ways

    no = (10 ** 9, "~", [])
    ways = closed([(0, "", []), no, no, (0, "", [])])
    for (_, role, text), fault in reversed(list(zip(rows, faults(rows)))):
        best = []
        for q in range(4):
            mine = [(ways[q][0] + 3, "D" + ways[q][1], ways[q][2])]
            if fault in (None, "truncated"):
                cut = fault == "truncated"
                to = KEEP[q].get(role[:1])
                if to is not None:
                    mine.append((ways[to][0] + cut, "K" + ways[to][1], [f"{role}:{text}"] + ways[to][2]))
                to = ONWARD[q]
                mine.append((ways[to][0] + 2 + cut, "R" + ways[to][1], [f"{ROLE[to]}:{text}"] + ways[to][2]))
            best.append(min(mine))
        ways = closed(best)
    return ways[0]


def report(rows):
    """The whole row of a conversation after damage, without its identifier."""
    dates = [t for t, _, _ in rows if t is not None]
    found, pairs = faults(rows), zip(rows, rows[1:])
    cost, audit, lines = repair(rows)
    return (max(dates) - min(dates) + 1 - len(set(dates)) if dates else 0,
            *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def after_damage(rows):
    """Conversations of ``(conv_id, turn, role, text)`` after damage, in order."""
    space, out = lambda x: " " if x is None else x, {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        harm = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        mine += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)

    def place(row):
        digest = hashlib.sha256(f"{len(row[1].encode())}:{row[1]}{row[2]}".encode()).hexdigest()
        return row[0] is not None, row[0] or 0, row[1].encode(), digest

    return {conv: sorted(mine, key=place) for conv, mine in out.items()}


def some_rows(seed):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "a. b", "what?\n", "x" * 40_000 + ".", "é日本。", "Fine."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 30])):
            rows.append((conv, rng.choice([turn, turn, turn + 1, turn * 3, None]), rng.choice(roles), rng.choice(texts)))
    # a conversation that no partition holds alone
    rows += [(7, 100 + i // 2, rng.choice(roles), rng.choice(texts[:4] + [f"turn {i}.", f"turn {i}"])) for i in range(3000)]
    rows += [(8, None, "user", "again.")] * 900 + [(None, None, None, None)] * 50
    rng.shuffle(rows)
    return rows


@pytest.mark.usefixtures("many_pieces")
@pytest.mark.parametrize("seed", [1, 2])
def test_reports_of_cut_conversations(spark, seed):
    rows = some_rows(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair_report(damaged(df)).collect()}
    assert got == {conv: report(mine) for conv, mine in after_damage(rows).items()}


@pytest.mark.usefixtures("many_pieces")
def test_turns_of_cut_conversations(spark):
    rows = some_rows(3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in sorted(repaired_turns(damaged(df)).collect(), key=lambda r: (r.piece, r.step)):
        got.setdefault(r.conv_id, []).append(r)
    for conv, mine in after_damage(rows).items():
        _, audit, lines = repair(mine)
        found = got.get(conv, [])
        assert "".join(r.edit for r in found) == audit
        assert [f"{r.role}:{r.text}" for r in found if r.edit != "D"] == lines
        assert [r.turn for r in found if r.edit != "I"] == [t for t, _, _ in mine]


def test_undamaged_turns_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "So")], "conv_id long, turn long, role string, text string")
    row = repair_report(turns(df)).first()
    cost, audit, _ = repair([(0, "assistant", "Hello."), (1, "user", "So")])
    assert (row.cost, row.audit, row.truncated, row.illegal) == (cost, audit, 1, 0)
    assert repair_report(damaged(df.limit(0))).count() == 0 and repaired_turns(damaged(df.limit(0))).count() == 0


def test_blocks_against_single_turns():
    rng = random.Random(5)
    roles = "suax"
    for _ in range(3000):
        rows = [(i, rng.choice(roles), rng.choice(["", f"{i}.", f"{i}"])) for i in range(rng.randrange(15))]
        signs = bytes(0 if not t else 1 + 2 * "suax".index(r) + (t[-1] != ".") for _, r, t in rows)
        assert trace(signs)[0] == repair(rows)[1]


def test_pieces_compose():
    """A sequence cut anywhere, summarised piece by piece, has the edits of the whole."""
    rng = random.Random(6)
    for _ in range(500):
        signs = bytes(rng.choice([0, 1, 2, 3, 3, 4, 5, 5, 6, 7, 8]) for _ in range(rng.randrange(1, 40)))
        at = sorted(rng.randrange(len(signs) + 1) for _ in range(3))
        parts = [signs[a:b] for a, b in zip([0, *at], [*at, len(signs)])]
        maps = [summary(p) for p in parts]
        behind, vector = [], 0
        for front, _ in reversed(maps):
            behind.append(vector)
            vector = front[vector]
        letters, state = "", 0
        for n, (part, (_, leads), vector) in enumerate(zip(parts, maps, reversed(behind))):
            text, after = trace(part, vector, state, n == len(parts) - 1)
            assert n == len(parts) - 1 or after == leads[4 * vector + state]
            letters, state = letters + text, after
        assert letters == trace(signs)[0]
    assert len(blocks(b"\x01" * (BLOCK + 1))) == 2 and len(tables().vectors) < 64
